"""Sessions, lineage cuts, whole-pipeline jobs and the registered queries."""
