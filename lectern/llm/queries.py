"""The queries of this package by name, and SQL for those that have any."""

from __future__ import annotations

from lectern.llm.bundles import p1_found
from lectern.llm.matching import p3_found, p3_matches
from lectern.llm.mixing import p9_mix, p9_shares, p9_shares_full
from lectern.llm.names import p6_authors, p6_found
from lectern.llm.packing import p8_fill, p8_pack
from lectern.llm.scans import p2_found, p2_repaired
from lectern.llm.sentences import p10_found
from lectern.llm.survivors import p5_found, p5_records
from lectern.llm.vectors import p4_found, p4_knn

QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_repaired, p3_found, p3_matches, p4_found, p4_knn, p5_found, p5_records, p6_found, p6_authors, p8_pack, p8_fill, p9_mix, p9_shares, p9_shares_full, p10_found)}
SQL: dict[str, str] = {}
