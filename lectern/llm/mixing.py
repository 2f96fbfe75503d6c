"""Problem 9: sources mixed to target weights.

Hierarchical budgeting: the sources' target shares are spread over a domain-language-source tree (within a source by the languages'
own sizes); the budget flows down from the root, each child gets its weight's part but at most what its leaves can give (tokens times
allowed repeats), and what a child can't take goes to its siblings before it goes to the ancestors' other branches. Each leaf then takes
whole seeded epochs and a token-prefix of the next one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.tokens import VOCABULARY, token_counts
from lectern.plans.runtime import cut, table

#: The domain of each source; sources not named are a domain of their own.
DOMAINS = {"abstract": "paper", "pdf_fulltext": "paper", "thesis_chapter": "paper", "erratum": "paper", "llm_summary": "derived", "crossref_note": "derived", "zotero_note": "personal", "application_note": "personal", "readme": "teaching", "lecture_slides": "teaching", "maze_caption": "teaching"}


@dataclass
class Node:
    weight: float = 0.0
    capacity: float = 0.0
    budget: float = 0.0
    children: dict = field(default_factory=dict)


def spread(node: Node, budget: float) -> None:
    """Give `budget` (at most the node's capacity) to the leaves: by weight, and what one can't take to its siblings."""
    node.budget = min(budget, node.capacity)
    rest, open_ = node.budget, dict(node.children)
    share = {k: 0.0 for k in open_}
    while open_ and rest > 1e-9:
        weight = sum(c.weight for c in open_.values())
        if weight <= 0:
            break
        short = {k: c for k, c in open_.items() if share[k] + rest * c.weight / weight >= c.capacity}
        if not short:
            for k, c in open_.items():
                share[k] += rest * c.weight / weight
            break
        for k, c in short.items():
            rest -= c.capacity - share[k]
            share[k] = c.capacity
            del open_[k]
    for k, c in node.children.items():
        spread(c, share[k])


def reachable(size: dict[str, int], live: dict[str, tuple[float, int]], slack: float) -> float:
    """The largest total at which the sources fall short of their (rescaled) shares by at most `slack` of the total, all together."""
    found = sum(share for share, _ in live.values())
    caps = [(share / found, size[s] * repeats) for s, (share, repeats) in live.items()]
    low, high = 0.0, float(sum(c for _, c in caps))
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(max(0.0, w - c / mid) for w, c in caps) <= slack else (low, mid)
    return low


def budgets(leaves: list[tuple[str, str, str, int]], targets: dict[str, tuple[float, int]], total: float | None = None, slack: float = 0.0) -> dict[tuple[str, str, str], float]:
    """Tokens for each leaf (domain, language, source) of `leaves` (with its tokens).

    total None: the largest total at which all sources with texts together miss at most `slack` of it, so that one tiny source can't
    shrink the mix; with slack 0 every source with texts reaches its share.
    """
    size: dict[str, int] = {}
    for _, _, s, n in leaves:
        size[s] = size.get(s, 0) + n
    live = {s: v for s, v in targets.items() if size.get(s) and v[0] > 0 and v[1] > 0}
    if total is None:
        total = reachable(size, live, slack) if live else 0.0
    root = Node()
    # a source without texts holds its weight where it belongs, so that its siblings take it over
    missing = [(DOMAINS.get(s, s), "", s, 0) for s, v in targets.items() if s not in live]
    for domain, lang, source, n in [*leaves, *missing]:
        if source not in targets:
            continue
        share, repeats = targets[source]
        w, c = share * (n / size[source] if n else 1.0), n * max(0, repeats)
        at = root
        for name in (None, domain, lang, source):
            if name is not None:
                at = at.children.setdefault(name, Node())
            at.weight += w
            at.capacity += c
    spread(root, total)
    return {(d, l, s): leaf.budget for d, dn in root.children.items() for l, ln in dn.children.items() for s, leaf in ln.children.items() if leaf.capacity}


def mix(docs: DataFrame, targets: DataFrame, total: float | None = None, slack: float = 0.0, seed: int = 17, per_bucket: int = 20_000, max_leaves: int = 100_000) -> DataFrame:
    """(doc_id, source, lang, epoch, n_tokens): the documents to take, one row per use, for `docs(doc_id, source, lang, n_tokens)`
    and `targets(source, target_share, max_repeats)`.

    Sources without a target, documents without tokens and rows with null source are not taken; languages are compared without blanks
    and case, null is `und`; repeated rows are documents of their own; null shares and repeats count as 0. Only leaf totals come to the
    driver (sources with targets times languages, at most `max_leaves`, else an error). An empty table gives no rows.
    """
    spark = docs.sparkSession
    want = {r.source: (float(r.target_share or 0), int(r.max_repeats or 0)) for r in targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).limit(max_leaves + 1).collect()}
    if len(want) > max_leaves:
        raise ValueError(f"more than {max_leaves} targets")
    lang = F.coalesce(F.nullif(F.lower(F.trim("lang")), F.lit("")), F.lit("und"))
    named = F.broadcast(spark.createDataFrame([(s, DOMAINS.get(s, s)) for s in want], "source string, domain string"))
    rows = docs.where("n_tokens > 0").join(named, "source").select("doc_id", "source", lang.alias("lang"), "domain", "n_tokens")
    leaves = rows.groupBy("domain", "lang", "source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).limit(max_leaves + 1).collect()
    if len(leaves) > max_leaves:
        raise ValueError(f"more than {max_leaves} leaves")
    given = budgets([(r.domain, r.lang, r.source, r.tokens) for r in leaves], want, total, slack)
    plan = []
    for r in leaves:
        b = min(given.get((r.domain, r.lang, r.source), 0.0), r.tokens * want[r.source][1])
        whole = int(b // r.tokens)
        plan.append((r.domain, r.lang, r.source, whole, float(b - whole * r.tokens), -(-r.docs // per_bucket)))
    leaf = F.broadcast(spark.createDataFrame(plan, "domain string, lang string, source string, whole int, rest double, buckets int"))
    keys = ["domain", "lang", "source"]
    order = F.xxhash64("doc_id", "n_tokens", "whole", F.lit(seed))
    part = rows.join(leaf, keys).withColumn("h", order).withColumn("bucket", F.floor(F.pmod(F.shiftright("h", 20), F.lit(1 << 40)) * F.col("buckets") / (1 << 40)))
    # a prefix of the next epoch without a sort of a whole leaf: totals by bucket first, rows only in the bucket where the prefix ends
    by = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = part.groupBy(*keys, "bucket").agg(F.sum("n_tokens").alias("held")).withColumn("before", F.coalesce(F.sum("held").over(by), F.lit(0)))
    placed = part.join(sums, [*keys, "bucket"])
    inner = placed.where(F.col("before") + F.col("held") <= F.col("rest"))
    edge = placed.where((F.col("before") + F.col("held") > F.col("rest")) & (F.col("before") < F.col("rest")))
    upto = F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*keys, "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    edge = edge.withColumn("upto", upto).where(F.col("upto") - F.col("n_tokens") / 2 <= F.col("rest")).drop("upto")
    cols = ["doc_id", "source", "lang", "epoch", "n_tokens"]
    repeats = part.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole") - 1))).select(*cols)
    return repeats.unionByName(inner.unionByName(edge).withColumn("epoch", F.col("whole")).select(*cols))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, uses, most_uses): one row per target, sources without texts included."""
    got = mixed.groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("u")).groupBy("source").agg(F.sum("t").alias("tokens"), F.sum("u").alias("uses"), F.max("u").alias("most_uses"))
    all_ = got.agg(F.sum("tokens").alias("all_tokens"))
    out = targets.select("source", "target_share").join(got, "source", "left").join(F.broadcast(all_), how="cross")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("source", "target_share", F.round(zero(F.try_divide("tokens", "all_tokens")), 6).alias("actual_share"), zero("tokens").alias("tokens"), zero("uses").alias("uses"), zero("most_uses").alias("most_uses"))


def _counted(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return cut(token_counts(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"), "text", vocabulary))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the largest mix in which every source with texts reaches its target share."""
    return mix(_counted(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets")
    return shares(mix(_counted(spark, sf_dir), targets), targets)


def p9_shares_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached when the mix has as many tokens as all documents together: small sources fall short, siblings fill in."""
    docs, targets = _counted(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    return shares(mix(docs, targets, total=float(docs.agg(F.sum("n_tokens")).first()[0] or 0)), targets)
