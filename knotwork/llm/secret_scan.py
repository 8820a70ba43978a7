"""Secret scans over an incremental ledger of blobs.

Every text is a version of a path (its document) and is addressed by its SHA-256.  The ledger
holds which rules, by version, each blob has been through, and what they found, clean blobs
included.  A run hashes all texts, looks the ledger up by blob, and takes one path of each blob
with a rule to run; no pattern is tried on any other text.  Findings are joined back to all
paths by blob.  Only texts with a finding may travel through a shuffle, as long as the lists of
blobs to scan or to leave out stay under ``_LISTED`` rows; beyond that, texts are joined by blob.
DataFrame functions only.

Defined results: a null text counts as empty; a null doc_id is a path like any other;
repeated rows are paths of one blob and each gets the findings (rows that repeat id and text are
each scanned, with one result); spans are in code points, end exclusive; an empty table gives an
empty table; only ``doc_id`` and ``text`` are read, so further columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.plans import scratch


_LISTED = 300_000  # rows of a hash of 32 bytes and a long that a broadcast may hold, 20 MB or so


@dataclass(frozen=True)
class Rule:
    """A match counts if its group ``group`` has ``least`` characters; matches are leftmost and
    do not overlap.  ``needs``: literals of which every text with a match holds one (empty: none)."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    needs: tuple[str, ...] = ()
    base: bool = False

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The rules, in the order in which findings at one place are listed.
_KEYS = ("password", "passwd", "secret", "token", "api_?key")
RULES = (
    Rule("assign", 1, "(?:" + "|".join(map(_either_case, _KEYS)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8, (":", "="), True),
    Rule("access", 1, "AKIA[A-Z0-9]+", 0, 16, ("AKIA",), True),
    Rule("hex", 1, "[0-9a-f]{32,}", 0, 32, (), True),
    Rule("pem", 1, "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 0, ("-----BEGIN",)),
    Rule("github", 1, "gh[pousr]_[A-Za-z0-9]{36,}", 0, 0, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}", 0, 0, ("eyJ",)),
)


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def may_match(text: Column, rule: Rule) -> Column:
    """Cheap test that every text with a finding of the rule passes."""
    literal = reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in rule.needs]) if rule.needs else F.lit(True)
    return F.coalesce(literal & text.rlike(rule.pattern), F.lit(False))


def _listed(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it is small; df is a stored table of blobs."""
    return F.broadcast(df) if df.count() <= _LISTED else df


def addressed(docs: DataFrame) -> DataFrame:
    """(doc_id, blob) of every path, a stored table."""
    return scratch.table(docs.select("doc_id", blob_of(F.col("text")).alias("blob")), "paths")


def due(paths: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, path, copies, todo) of each blob with rules that the ledger does not hold for it, a stored
    table: the smallest path's id, the number of paths, and the names of those rules."""
    every = F.array(*[F.lit(r.name) for r in rules])
    blobs = paths.groupBy("blob").agg(F.min("doc_id").alias("path"), F.count(F.lit(1)).alias("copies"))
    if ledger is None:
        return scratch.table(blobs.withColumn("todo", every), "due")
    known = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("done"))).alias("done"))
    left = blobs.join(known, "blob", "left").withColumn("todo", F.array_except(every, F.coalesce("done", F.array().cast("array<string>"))))
    return scratch.table(left.where(F.size("todo") > 0).select("blob", "path", "copies", "todo"), "due")


def unseen(docs: DataFrame, work: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, todo, text) of the texts that rules are run on: one path of each blob in ``work``."""
    hashed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), blob_of(F.col("text")).alias("blob"))
    mine = F.col("doc_id").eqNullSafe(F.col("path"))
    if ledger is None:  # every blob is due; only copies are left out
        copied = scratch.table(work.where("copies > 1").select("blob", "path", F.lit(True).alias("copied")), "copied")
        picked = hashed.join(_listed(copied), "blob", "left").where(F.col("copied").isNull() | mine)
        return picked.select("blob", F.array(*[F.lit(r.name) for r in rules]).alias("todo"), "text")
    return hashed.join(_listed(work.select("blob", "path", "todo")), "blob").where(mine).select("blob", "todo", "text")


def screened(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, rule, text) of the rules to do that match somewhere in a text."""
    hit = [F.when(F.array_contains("todo", r.name) & may_match(F.col("text"), r), F.lit(r.name)) for r in rules]
    some = texts.select("blob", "text", F.array_compact(F.array(*hit)).alias("hit")).where(F.size("hit") > 0)
    return some.dropDuplicates(["blob"]).select("blob", F.explode("hit").alias("rule"), "text")


def matches(pairs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, rule, start, stop) of every finding in pairs(blob, rule, text).

    The text between matches comes from ``split``, so offsets are running sums of lengths: linear
    in the matches, however many a long text holds."""
    none = F.array().cast("array<string>")
    pick = lambda make: reduce(lambda rest, r: F.when(F.col("rule") == r.name, make(r)).otherwise(rest), rules, none)
    found = pairs.select(
        "blob",
        "rule",
        F.posexplode(
            F.arrays_zip(
                F.transform(pick(lambda r: F.split("text", r.pattern, -1)), F.length).alias("gap"),
                F.transform(pick(lambda r: F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))), F.length).alias("size"),
                F.transform(pick(lambda r: F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group))), F.length).alias("value"),
            )
        ).alias("n", "m"),
    )
    upto = Window.partitionBy("blob", "rule").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = F.sum(F.col("m.gap") + F.coalesce("m.size", F.lit(0))).over(upto)
    least = reduce(lambda rest, r: F.when(F.col("rule") == r.name, F.lit(r.least)).otherwise(rest), rules, F.lit(0))
    return (
        found.withColumn("stop", ends)
        .where(F.col("m.size").isNotNull() & (F.col("m.value") >= least))
        .select("blob", "rule", (F.col("stop") - F.col("m.size")).cast("long").alias("start"), F.col("stop").cast("long"))
    )


@dataclass
class Scan:
    """paths(doc_id, blob), ledger(blob, done, spans) and blobs(blob, hits) with each blob's findings of
    the current rule versions, by start and then the rules' order."""

    paths: DataFrame
    ledger: DataFrame
    blobs: DataFrame


SPANS = "array<struct<rule:string,start:bigint,stop:bigint>>"


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> Scan:
    """Scan what the ledger of earlier runs does not hold; the result's ledger is that one with this
    run's blobs, those without a finding too."""
    paths = addressed(docs)
    work = due(paths, ledger, rules)
    found = matches(screened(unseen(docs, work, ledger, rules), rules), rules).groupBy("blob").agg(F.collect_list(F.struct("rule", "start", "stop")).alias("spans"))
    rows = scratch.table(work.join(found, "blob", "left").select("blob", F.col("todo").alias("done"), F.coalesce("spans", F.array().cast(SPANS)).alias("spans")), "ledger")
    whole = rows if ledger is None else ledger.select(rows.columns).unionByName(rows)
    order = F.map_from_arrays(F.array(*[F.lit(r.name) for r in rules]), F.array(*[F.lit(i) for i in range(len(rules))]))
    kind = F.map_from_arrays(F.array(*[F.lit(r.name) for r in rules]), F.array(*[F.lit(r.kind) for r in rules]))
    rule = F.col("s.rule")
    hits = (
        whole.where(F.size("spans") > 0)
        .select("blob", F.explode("spans").alias("s"))
        .where(rule.isin([r.name for r in rules]))
        .groupBy("blob")
        .agg(F.sort_array(F.collect_set(F.struct(F.col("s.start").alias("start"), F.element_at(order, rule).alias("kind_order"), F.col("s.stop").alias("stop"), F.element_at(kind, rule).alias("kind")))).alias("hits"))
    )
    return Scan(paths, whole, scratch.table(hits, "hits"))


def joined(hits: Column) -> Column:
    return F.array_join(F.transform(hits, lambda h: F.concat_ws(":", h["kind"], h["start"].cast("string"), h["stop"].cast("string"))), ",")


def findings(result: Scan, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each path: doc_id and its blob's hits (an empty array where there are none)."""
    kind = "array<struct<start:bigint,kind_order:int,stop:bigint,kind:string>>"
    return result.paths.select("doc_id", "blob").join(result.blobs, "blob", "left").select("doc_id", F.coalesce("hits", F.array().cast(kind)).alias("hits"))


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    base = [r.kind for r in rules if r.base]
    count = lambda kind: F.size(F.filter("hits", lambda h: h["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(joined(F.filter("hits", lambda h: h["kind"].isin(base))), 256).alias("base_sha256"),
        joined(F.col("hits")).alias("spans"),
    )


def masked(text: Column, hits: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones as one, replaced by ``mask``: the stretches that are kept,
    joined once, so that no text is copied a hit."""
    stops = F.transform(hits, lambda h: h["stop"])
    reach = lambda i: F.array_max(F.slice(stops, F.lit(1), i))  # noqa: E731  furthest stop of the first i spans
    # a span that begins within what the ones before it reach adds nothing to keep
    cuts = F.transform(hits, lambda h, i: F.struct(F.coalesce(F.when(i > 0, reach(i)), F.lit(0)).alias("at"), h["start"].alias("to")))
    kept = F.transform(F.filter(cuts, lambda c: c["to"] >= c["at"]), lambda c: text.substr((c["at"] + 1).cast("int"), (c["to"] - c["at"]).cast("int")))
    return F.concat(F.array_join(kept, mask), F.lit(mask), text.substr((F.array_max(stops) + 1).cast("int"), F.length(text)))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with the secrets in ``text`` masked; columns and all rows stay.  Rows without a finding are
    not shuffled unless very many blobs have one."""
    result = scan(docs, None, rules)
    hot = _listed(scratch.table(result.blobs.select(F.col("blob").alias("__blob")), "hot"))
    hashed = docs.withColumn("__blob", blob_of(F.col("text")))
    cured = hashed.join(hot, "__blob", "left_semi").join(result.blobs.select(F.col("blob").alias("__blob"), F.col("hits").alias("__hits")), "__blob")
    return hashed.join(hot, "__blob", "left_anti").select(*docs.columns).unionByName(cured.withColumn("text", masked(F.col("text"), F.col("__hits"))).select(*docs.columns))


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The same digest in DuckDB SQL."""
    q = lambda s: s.replace("'", "''")
    parts = []
    for i, r in enumerate(rules):
        parts.append(
            f"SELECT row_id, {i} AS o, '{r.kind}' AS kind, unnest(range(1, len(w) + 1)) AS n, w, v, g, {r.least} AS least FROM "
            f"(SELECT row_id, regexp_extract_all(text, '{q(r.pattern)}', 0) AS w, regexp_extract_all(text, '{q(r.pattern)}', {r.group}) AS v, string_split_regex(text, '{q(r.pattern)}') AS g FROM d)"
        )
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({' UNION ALL '.join(parts)}),
s AS (SELECT row_id, o, kind, (list_sum(list_transform(g[1:n], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:n-1], lambda x: length(x))), 0))::BIGINT AS a, length(w[n]) AS size
      FROM m WHERE length(v[n]) >= least),
f AS (SELECT row_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      string_agg(kind || ':' || a || ':' || (a + size), ',' ORDER BY a, o) FILTER (kind IN ('assign', 'access', 'hex')) AS base,
      string_agg(kind || ':' || a || ':' || (a + size), ',' ORDER BY a, o) AS spans FROM s GROUP BY row_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN f USING (row_id)"""
