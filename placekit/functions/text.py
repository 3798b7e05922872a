"""Names, sentences and wording."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from placekit.functions.vocab import (
    DISSOLVE_ISO3, DISSOLVE_LABELS, ENTRY_STATES, ENTRY_SUBTYPES, KINDS, UNRULED_LABELS, lookup,
)

# Settlement spellings that name the same town.
NAMESAKES = {"tanger": "tangier", "tangiers": "tangier", "fès": "fes", "fez": "fes"}


# ---------------------------------------------------------------- folding
@F.pandas_udf(StringType())
def _key_beyond_ascii(names: pd.Series) -> pd.Series:
    def one(text):
        plain = (c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
        return "".join(c for c in "".join(plain).casefold() if c.isalnum())

    return names.map(one, na_action="ignore")


@F.pandas_udf(StringType())
def _words_beyond_ascii(names: pd.Series) -> pd.Series:
    def one(text):
        return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").casefold()

    return names.map(one, na_action="ignore")


def _folded(name: Column | str, plain, beyond) -> Column:
    """Most names are ASCII and stay in built-in functions; Python sees only the others."""
    c = F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit(""))
    simple = c.rlike(r"^\p{ASCII}*$")
    return F.when(simple, plain(c)).otherwise(beyond(F.when(~simple, c)))


def fold_key(name: Column | str) -> Column:
    """Compatibility form, no marks, caseless, letters and digits only."""
    return _folded(name, lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", ""), _key_beyond_ascii)


def fold_words(name: Column | str) -> Column:
    """Canonical form, no non-spacing marks, caseless; spaces and signs stay."""
    return _folded(name, F.lower, _words_beyond_ascii)


def transliterates(a: Column, b: Column) -> Column:
    """Two folded names spell one place (P09): equal, a prefix short of two, or an edit or two."""
    la, lb = F.length(a), F.length(b)
    shorter = F.least(la, lb)
    prefix = ((F.abs(la - lb) <= 2)
              & (F.startswith(a, b) | F.startswith(b, a)))
    limit = F.when(shorter < 8, 1).otherwise(2)
    edits = F.levenshtein(a, b, 2)
    return (shorter > 0) & ((a == b) | prefix | ((edits >= 0) & (edits <= limit)))


def namesake_in(region: Column, settlement: Column, region_head: Column) -> Column:
    """A region's folded name holds a settlement's folded name, allowing known respellings.

    ``region_head`` is the folded first word of the region's name.
    """
    alias = lookup(NAMESAKES, settlement)
    head = F.coalesce(lookup(NAMESAKES, region_head), region_head)
    return (F.length(settlement) > 0) & (
        F.contains(region, settlement) | F.coalesce(F.contains(region, alias), F.lit(False))
        | (head == settlement))


def head_word(name: Column) -> Column:
    return F.split_part(F.trim(F.replace(name, F.lit("-"), F.lit(" "))), F.lit(" "), F.lit(1))


# ---------------------------------------------------------------- countries
_FOLDED_LABELS = {k.casefold(): v for k, v in DISSOLVE_LABELS.items()}


def canonical_country(label: Column) -> Column:
    """Disputed labels fold onto their host; others pass through trimmed."""
    return F.coalesce(lookup(_FOLDED_LABELS, F.lower(F.trim(label))), F.trim(label))


def canonical_iso3(code: Column) -> Column:
    clean = F.upper(F.trim(F.coalesce(code, F.lit(""))))
    return F.coalesce(lookup(DISSOLVE_ISO3, clean), clean)


def same_identity_country(old: Column, new: Column) -> Column:
    """A relabelled country is the same place, not a reused id."""
    a, b = canonical_country(old), canonical_country(new)
    ia, ib = canonical_iso3(old), canonical_iso3(new)
    return (old == new) | (a == b) | ((ia == ib) & (ia != "")) | (a == new) | (ia == F.upper(new))


def disputed_case(label: Column) -> Column:
    """Name of an unruled dispute, or null."""
    return lookup(UNRULED_LABELS, F.lower(F.trim(label)))


def fingerprint(name: Column, country: Column, lat: Column, lon: Column) -> Column:
    """Enough to tell that place from another wearing its id."""
    return F.concat_ws("|", country, F.lower(F.trim(name)),
                       F.bround(lat, 3).cast("string"), F.bround(lon, 3).cast("string"))


# ---------------------------------------------------------------- entry rules
def entry_state(requirement: Column) -> Column:
    """Requirement wording to struct<r, d, v>; wording nobody has seen is an error."""
    raw = F.lower(F.trim(F.coalesce(requirement, F.lit(""))))
    days = F.when(raw.rlike("^[+-]?[0-9]+$"), raw.try_cast("int"))
    known = lookup(ENTRY_STATES, raw)
    unseen = F.raise_error(F.concat(F.lit("unhandled requirement value: "), raw))
    state = F.coalesce(known, F.when(days < 0, "home").when(days.isNotNull(), "vf")).alias("r")
    state = F.coalesce(known, F.when(days < 0, "home").when(days >= 0, "vf"), unseen.cast("string"))
    return F.struct(state.alias("r"), F.when(known.isNull() & (days >= 0), days).alias("d"),
                    lookup(ENTRY_SUBTYPES, raw).alias("v"))


# Traveller wording of entry states.
ENTRY_LABELS = {
    "vf": "No visa needed", "voa": "Visa on arrival", "ev": "Apply online first",
    "vr": "Apply in advance", "na": "No admission", "home": "Your own country",
}
ENTRY_MEANS = {
    "vf": "no visa", "voa": "a visa on arrival", "ev": "an e-visa applied for online",
    "vr": "a visa applied for before travelling", "na": "no admission at present",
}


def entry_text(r: Column, d: Column, v: Column) -> Column:
    return (F.when(r.isNull(), "Not in the passport index")
            .when((r == "vf") & (F.coalesce(d, F.lit(0)) > 0), F.concat(F.lit(ENTRY_LABELS["vf"]), F.lit(" · "), d.cast("string"), F.lit(" days")))
            .when((r == "ev") & (v == "eta"), "Travel authorisation first")
            .otherwise(lookup(ENTRY_LABELS, r)))


def entry_sentence(r: Column, d: Column, v: Column, country: Column, passport: Column) -> Column:
    days = F.when((r == "vf") & (F.coalesce(d, F.lit(0)) > 0), F.concat(F.lit(" for up to "), d.cast("string"), F.lit(" days"))).otherwise("")
    how = F.when((r == "ev") & (v == "eta"), "a travel authorisation applied for online").otherwise(lookup(ENTRY_MEANS, r))
    on = F.concat(F.lit(" on a "), passport, F.lit(" passport."))
    return (F.when(r.isNull(), F.concat(country, F.lit(" is not covered by the passport index, so no entry requirement is stated here.")))
            .when(r == "home", F.concat(country, F.lit(" is your own passport's country.")))
            .when(r == "na", F.concat(country, F.lit(" allows "), how, on))
            .otherwise(F.concat(country, F.lit(" needs "), how, days, on)))


# ---------------------------------------------------------------- sentences
def listed(items: Column, last_of_two: str = " and ", last: str = " and ") -> Column:
    """`a`, `a and b`, `a, b and c`."""
    n = F.size(items)
    return (F.when(n == 0, "").when(n == 1, F.get(items, F.lit(0)))
            .when(n == 2, F.array_join(items, last_of_two))
            .otherwise(F.concat(F.array_join(F.slice(items, F.lit(1), n - 1), ", "), F.lit(last),
                                F.get(items, n - 1))))


_PROSE = {k: v.lower().replace(" / ", " or ", 1) for k, v in KINDS.items()}


def gap_sentence(unseen: Column) -> Column:
    """`Still unseen: a, b, and c.` from kind codes; empty when nothing is."""
    said = listed(F.transform(unseen, lambda c: lookup(_PROSE, c)), " and ", ", and ")
    return F.when(F.size(unseen) == 0, "").otherwise(F.concat(F.lit("Still unseen: "), said, F.lit(".")))


def coverage_count(seen: Column, available: Column) -> Column:
    return F.concat(seen.cast("string"), F.lit(" of "), available.cast("string"))


def coverage_unit(available: Column) -> Column:
    return F.when(available == 1, "kind of place seen").otherwise("kinds of place seen")


def coverage_gap_voice(unseen: Column, available: Column, scope: Column) -> Column:
    return (F.when(F.size(unseen) > 0, gap_sentence(unseen))
            .when(available == 0, "No places here yet.")
            .otherwise(F.concat(F.lit("Every kind of place "), scope, F.lit(" has is on your record."))))


# One clause per source, in the order a traveller ranks them.
SOURCE_CLAUSES = (
    ("unesco-whs", None),
    ("wdpa", "protected land around it"),
    ("osm", "a mapped concentration of institutions, markets and workshops"),
    ("wikidata", "documented heritage items"),
    ("cuisine", "a food region of its own"),
    ("ghsl-ucdb", "a recognised urban centre"),
)


def why_here(sources: Column, kind_codes: Column, whs: Column, is_site: Column) -> Column:
    """Why a place is on the map, from its provenance only."""
    inscribed = (F.when(whs == 1, "a World Heritage inscription")
                 .when(whs > 1, F.concat(whs.cast("string"), F.lit(" World Heritage inscriptions")))
                 .otherwise("a World Heritage listing"))
    parts = [F.when(F.array_contains(sources, s), inscribed if said is None else F.lit(said))
             for s, said in SOURCE_CLAUSES]
    parts.append(F.when(F.array_contains(kind_codes, "A2"), "a living old town"))
    said = F.filter(F.array(*parts), lambda p: p.isNotNull())
    subject = F.when(is_site, "This site").otherwise("This place")
    thin = F.when(F.size(kind_codes) > 0, "It is in the database on its name, position and kind of place. That is thin, and worth telling us about.").otherwise(
        "It is in the database on its name and position alone. That is thin, and worth telling us about.")
    return F.when(F.size(said) == 0, thin).otherwise(
        F.concat(subject, F.lit(" is here for "), listed(said), F.lit(".")))


def standing(score: Column, country: Column, printed: Column, rank: Column) -> Column:
    """The score said against its own country, never the world."""
    rel = F.when(score >= 100, F.concat(F.lit("Nothing in "), country, F.lit(" scores higher."))).otherwise(
        F.concat(F.lit("It scores "), score.cast("string"), F.lit(" of 100 against the top place in "), country, F.lit(".")))
    drilled = F.when(printed & (F.coalesce(rank, F.lit(0)) > 0), F.concat(
        F.lit(" It is number "), rank.cast("string"), F.lit(" of the places in "), country,
        F.lit(" that reach the printed map."))).otherwise(
        " It does not reach the printed map, which is a question of hole spacing rather than of merit.")
    return F.concat(rel, drilled)


def travel_effort(reach: Column) -> Column:
    """Only a computed reach is said; 'near' was a placeholder and reads as absence."""
    return (F.when(reach == "mid", "A few hours from an international gateway.")
            .when(reach == "far", "A day’s travel from an international gateway.")
            .when(reach == "remote", "Remote from international gateways."))


def pillar_bars(h: Column, n: Column, liv: Column, livability: Column) -> Column:
    """Shares clamped to 0..1; a pillar nobody scored is null, not zero."""
    def share(v):
        return F.when(v.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)))

    living = F.when(F.coalesce(livability, F.lit("")) != "unscored", share(liv))
    rows = (("heritage", "Built heritage", share(h)), ("nature", "Natural setting", share(n)),
            ("living", "Living culture", living))
    return F.array(*[F.struct(F.lit(i).alias("id"), F.lit(l).alias("label"), s.alias("share")) for i, l, s in rows])


_MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August",
           "September", "October", "November", "December")


def when_to_go(months: Column) -> Column:
    n = F.size(F.coalesce(months, F.array().cast("array<int>")))
    named = F.transform(months, lambda m: F.element_at(F.array(*[F.lit(x) for x in _MONTHS]), m))
    return (F.when(n == 0, "We don’t know when to go.").when(n == 12, "Any month.")
            .otherwise(F.concat(F.lit("Typically better in "), listed(named), F.lit("."))))


def months_in_range(start: Column, end: Column) -> Column:
    """Months an inclusive date range touches, walked a month at a time for at most 24 steps.

    A day the next month lacks runs over into the month after, as calendar arithmetic does.
    """
    a, b = F.least(start, F.coalesce(end, start)), F.greatest(start, F.coalesce(end, start))

    def onward(d: Column) -> Column:
        return F.date_add(F.add_months(F.trunc(d, "MM"), 1), F.dayofmonth(d) - 1)

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(23)), F.array(a), lambda acc, _: F.concat(acc, F.array(onward(F.element_at(acc, -1)))))
    seen = F.transform(F.filter(walk, lambda d: d <= b), lambda d: F.month(d))
    return F.when(start.isNull(), F.array().cast("array<int>")).otherwise(F.array_distinct(seen))


def parse_point(wkt: Column) -> tuple[Column, Column]:
    """`Point(lon lat)` to (lat, lon); null when malformed."""
    number = r"^Point\(\s*(\S+)\s+([^\s)]+)\s*\)*$"
    lon = F.nullif(F.regexp_extract(wkt, number, 1), F.lit("")).try_cast("double")
    lat = F.nullif(F.regexp_extract(wkt, number, 2), F.lit("")).try_cast("double")
    both = lon.isNotNull() & lat.isNotNull()
    return F.when(both, lat), F.when(both, lon)


def qid(uri: Column) -> Column:
    return F.substring_index(uri, "/", -1)
