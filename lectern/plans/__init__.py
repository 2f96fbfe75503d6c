"""Run-time helpers shared by the operators: table reads and lineage cuts."""
