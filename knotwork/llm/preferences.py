"""Preference formatting of conversations.

A pair holds a chosen and a rejected conversation.  Their longest common prefix of turns (same
role, same text) is rendered once, as the prompt; what each goes on with is its completion.
Both completions come with their loss spans: the character ranges that the completion's own
assistant turns (and their end marks) take; everything else in a completion is masked.

A table of plain conversations has no rejected side, so ``opposed`` makes one.  The chosen side is
the conversation up to its last assistant turn.  The rejected side leaves it at one of its assistant
turns, drawn by the conversation's id, and goes on as another conversation does, the next one by id
in its bucket, from that one's first assistant turn to its last.  So sides part after any number of
turns, and completions hold several turns of either role.

Defined results: rows without conv_id or turn are left out, as no place in a conversation is
known; what follows a conversation's last assistant turn is left out; repeated rows of one turn are one turn, and of different rows of one turn the one with
the smallest role and then text counts; null roles are ``user``, null texts empty;
conversations without an assistant turn make no pair; a conversation that is alone in its
bucket is opposed by nothing more; where both sides are equal both completions are empty;
an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.plans import scratch

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Template:
    """What stands before a turn's text, with its role, and after it."""

    before: str = "<|{role}|>\n"
    after: str = "<|end|>\n"
    trained: str = "assistant"
    bucket: int = 64  # conversations that replies are exchanged in, on average


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns) of rows(conv_id, turn, role, text)."""
    clean = rows.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    one = clean.groupBy("conv_id", "turn").agg(F.min(F.struct(F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("t"))
    each = one.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "t"))).alias("all"))
    return each.select("conv_id", F.transform("all", lambda x: x["t"]).alias("turns"))


def _drawn(key: str, salt: str) -> str:
    """SQL of Spark for a pseudorandom number below 2^48, by the text of ``key``."""
    return f"CAST(conv(substr(md5(concat('{salt}', CAST({key} AS STRING))), 1, 12), 16, 10) AS BIGINT)"


def _places(turns: str, role: str) -> str:
    """SQL of Spark for the indexes, from 0, of the turns of a role."""
    return f"filter(transform({turns}, (t, i) -> CASE WHEN t.role = '{role}' THEN i END), i -> i IS NOT NULL)"


def opposed(convs: DataFrame, template: Template = Template()) -> DataFrame:
    """(pair_id, chosen, rejected) of conversations(conv_id, turns)."""
    places = convs.withColumn("at", F.expr(_places("turns", template.trained))).where(F.size("at") > 0)
    ending = places.select("conv_id", F.slice("turns", F.lit(1), F.array_max("at") + 1).alias("chosen"), "at")
    leaves = F.expr(f"at[CAST({_drawn('conv_id', 'leaves')} % size(at) AS INT)]")
    tail = F.slice("chosen", F.array_min("at") + 1, F.size("chosen"))
    stored = scratch.table(ending.select("conv_id", "chosen", leaves.alias("leaves"), tail.alias("tail")), "chosen")
    buckets = max(1, stored.count() // template.bucket)
    inside = Window.partitionBy("bucket").orderBy("conv_id")
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dealt = stored.withColumn("bucket", F.expr(f"{_drawn('conv_id', 'bucket')} % {buckets}"))
    other = F.coalesce(F.lead("tail").over(inside), F.when(F.count(F.lit(1)).over(whole) > 1, F.first("tail").over(whole)), F.array().cast(TURNS))
    return dealt.withColumn("other", other).select(F.col("conv_id").alias("pair_id"), "chosen", F.concat(F.slice("chosen", F.lit(1), F.col("leaves")), "other").alias("rejected"))


def _rendered(turn: Column, template: Template) -> Column:
    head, tail = template.before.split("{role}")
    return F.concat(F.lit(head), turn["role"], F.lit(tail), turn["text"], F.lit(template.after))


def _completion(turns: Column, template: Template) -> Column:
    """struct(text, spans): the turns rendered, and where their trained parts lie."""
    head, tail = template.before.split("{role}")
    pieces = F.transform(
        turns,
        lambda t: F.struct(
            (F.length(t["role"]) + len(head) + len(tail)).cast("long").alias("skip"),
            (F.length(t["text"]) + len(template.after)).cast("long").alias("own"),
            (t["role"] == template.trained).alias("learn"),
        ),
    )
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans"))
    walked = F.aggregate(
        pieces,
        empty,
        lambda acc, p: F.struct(
            (acc["at"] + p["skip"] + p["own"]).alias("at"),
            F.when(p["learn"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + p["skip"]).alias("start"), (acc["at"] + p["skip"] + p["own"]).alias("stop"))))).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return F.struct(F.array_join(F.transform(turns, lambda t: _rendered(t, template)), "").alias("text"), walked["spans"].alias("spans"))


def formatted(pairs: DataFrame, template: Template = Template()) -> DataFrame:
    """pair_id, common, prompt, chosen, chosen_spans, rejected, rejected_spans of
    pairs(pair_id, chosen, rejected), the sides arrays of struct(role, text)."""
    shorter = F.least(F.size("chosen"), F.size("rejected"))
    differs = F.zip_with(F.slice("chosen", F.lit(1), shorter), F.slice("rejected", F.lit(1), shorter), lambda a, b: a != b)
    first = F.array_position(differs, True)
    sides = pairs.withColumn("common", F.when(first > 0, first - 1).otherwise(shorter).cast("long"))
    rest = lambda side: F.slice(side, (F.col("common") + 1).cast("int"), F.greatest(F.size(side) - F.col("common"), F.lit(0)).cast("int"))
    made = sides.select(
        "pair_id",
        "common",
        F.array_join(F.transform(F.slice("chosen", F.lit(1), F.col("common").cast("int")), lambda t: _rendered(t, template)), "").alias("prompt"),
        _completion(rest("chosen"), template).alias("c"),
        _completion(rest("rejected"), template).alias("r"),
    )
    return made.select("pair_id", "common", "prompt", F.col("c.text").alias("chosen"), F.col("c.spans").alias("chosen_spans"), F.col("r.text").alias("rejected"), F.col("r.spans").alias("rejected_spans"))


def oracle(template: Template = Template()) -> str:
    """The query's rows in DuckDB SQL: opposition, longest common prefix, texts and spans."""
    head, tail = (x.replace("\n", "' || chr(10) || '") for x in template.before.split("{role}"))
    after = template.after.replace("\n", "' || chr(10) || '")
    before = f"'{head}' || t.role || '{tail}'"
    drawn = lambda salt: f"('0x' || substr(md5('{salt}' || conv_id::VARCHAR), 1, 12))::BIGINT"
    shown = lambda turns: f"array_to_string(list_transform({turns}, lambda t: {before} || t.text || '{after}'), '')"
    size = lambda t: f"length({before.replace('t.', t + '.')}) + length({t}.text || '{after}')"
    start = lambda turns: f"(coalesce(list_sum(list_transform({turns}[1:i - 1], lambda u: {size('u')})), 0) + length({before}))::BIGINT"
    spans = lambda turns: f"array_to_string(list_filter(list_transform({turns}, lambda t, i: CASE WHEN t.role = '{template.trained}' THEN {start(turns)} || ':' || ({start(turns)} + length(t.text || '{after}')) END), lambda s: s IS NOT NULL), ',')"
    return f"""
WITH r AS (SELECT conv_id, turn, min(struct_pack(role := coalesce(role, 'user'), text := coalesce(text, ''))) AS t FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
c AS (SELECT conv_id, list(t ORDER BY turn) AS turns FROM r GROUP BY conv_id),
p AS (SELECT conv_id, turns, list_filter(list_transform(turns, lambda t, i: CASE WHEN t.role = '{template.trained}' THEN i END), lambda i: i IS NOT NULL) AS spots FROM c),
e AS MATERIALIZED (SELECT conv_id, turns[1:list_max(spots)] AS chosen, spots[1 + {drawn('leaves')} % len(spots)] - 1 AS leaves, turns[list_min(spots):list_max(spots)] AS tail FROM p WHERE len(spots) > 0),
d AS (SELECT *, {drawn('bucket')} % greatest(1, (SELECT count(*) FROM e) // {template.bucket}) AS bucket FROM e),
o AS (SELECT conv_id, chosen, list_concat(chosen[1:leaves], coalesce(lead(tail) OVER w, CASE WHEN count(*) OVER b > 1 THEN first_value(tail) OVER w END, [])) AS rejected
      FROM d WINDOW w AS (PARTITION BY bucket ORDER BY conv_id), b AS (PARTITION BY bucket)),
m AS (SELECT *, least(len(chosen), len(rejected)) AS shorter FROM o),
l AS (SELECT *, coalesce(list_min(list_filter(range(1, shorter + 1), lambda k: chosen[k] <> rejected[k])) - 1, shorter)::BIGINT AS common FROM m),
f AS (SELECT conv_id, common, chosen[1:common] AS shared, chosen[common + 1:len(chosen)] AS c, rejected[common + 1:len(rejected)] AS j FROM l)
SELECT conv_id AS pair_id, common, {shown('shared')} AS prompt, {shown('c')} AS chosen, {spans('c')} AS chosen_spans, {shown('j')} AS rejected, {spans('j')} AS rejected_spans FROM f"""
