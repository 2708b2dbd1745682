"""Preference formatting (operator 7): one prompt, a chosen and a rejected completion, and what to train on.

Conversations with common beginnings are rivals. A conversation is set against the best one (the one in which assistants say
most) of those that share its longest shared beginning; the best one of its own longest shared beginning is set against the
second best. The prompt is the longest common turn prefix of the two, rendered once. The rest of each is its completion:
pieces of text with a flag, true for what an assistant says (with the end mark), false for headers and other roles.

Beginnings are found by a chain of digests, one for each turn, so a beginning is a key: the best of a key is a minimum that is
combined before the shuffle, and keys that very many conversations share are spread. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.operators.joins import spread_join
from cohortlens.session import materialise

END = "<|end|>\n"


def header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("")), F.lit("|>\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(header(t), F.coalesce(t["text"], F.lit("")), F.lit(END))), "")


def completion(turns: Column) -> Column:
    """Pieces of the turns in order: the header, untrained, and the body, trained if an assistant speaks."""
    return F.flatten(F.transform(turns, lambda t: F.array(
        F.struct(header(t).alias("text"), F.lit(False).alias("train")),
        F.struct(F.concat(F.coalesce(t["text"], F.lit("")), F.lit(END)).alias("text"), F.coalesce(t["role"] == "assistant", F.lit(False)).alias("train")))))


def common_turns(a: Column, b: Column) -> Column:
    """Number of leading turns with equal roles and texts (nulls equal nulls)."""
    n = F.least(F.size(a), F.size(b))
    differ = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (n > 0) & ~(
        F.get(a, i)["role"].eqNullSafe(F.get(b, i)["role"]) & F.get(a, i)["text"].eqNullSafe(F.get(b, i)["text"])))
    return F.coalesce(F.array_min(differ), n)


def format_pairs(pairs: DataFrame) -> DataFrame:
    """Adds prompt_turns, prompt, chosen, rejected to (…, chosen_turns, rejected_turns), arrays of (turn, role, text).

    Equal conversations have everything in the prompt and empty completions; so has one that is the other's beginning.
    A null side gives null columns.
    """
    n = F.col("prompt_turns")
    a, b = F.col("chosen_turns"), F.col("rejected_turns")
    out = pairs.withColumn("prompt_turns", F.when(a.isNotNull() & b.isNotNull(), common_turns(a, b)))
    return (out.withColumn("prompt", F.when(n.isNotNull(), render(F.slice(a, F.lit(1), F.coalesce(n, F.lit(0))))))
            .withColumn("chosen", F.when(n.isNotNull(), completion(F.slice(a, F.coalesce(n, F.lit(0)) + 1, F.size(a)))))
            .withColumn("rejected", F.when(n.isNotNull(), completion(F.slice(b, F.coalesce(n, F.lit(0)) + 1, F.size(b)))))
            .drop("chosen_turns", "rejected_turns"))


def gather(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of every conversation in order; repeated rows once, rows without an id left out."""
    return (turns.select("conv_id", "turn", "role", "text").where("conv_id is not null").distinct().groupBy("conv_id")
            .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")))


def beginnings(turns: Column) -> Column:
    """A key for the first turn, the first two, and so on: the digest of the key before and of the turn (nulls have a code)."""
    def code(c: Column) -> Column:
        return F.concat(F.coalesce(F.length(c).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(c, F.lit("")))

    return F.aggregate(turns, F.array().cast("array<string>"), lambda keys, t: F.concat(keys, F.array(
        F.sha2(F.concat(F.coalesce(F.get(keys, F.size(keys) - 1), F.lit("")), code(t["role"]), code(t["text"])), 256))))


def rivals(convs: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id, kind) for (conv_id, turns): ``pair`` as above; ``copy``: the conversation rejected_id is equal
    to chosen_id, the smallest id of its copies, which alone takes part in pairs; ``single``: shares no first turn with
    another (rejected_id is null)."""
    said = F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + F.when(t["role"] == "assistant", F.length(F.coalesce(t["text"], F.lit("")))).otherwise(0))
    keyed = materialise(convs.select("conv_id", (-said).alias("silent"), beginnings(F.col("turns")).alias("keys"))
                        .withColumn("whole", F.element_at("keys", -1)), "beginnings")
    same = materialise(keyed.groupBy("whole").agg(F.min("conv_id").alias("first"), F.count(F.lit(1)).alias("n")), "same")
    copies = (spread_join(keyed.select("conv_id", "whole"), same.where("n > 1"), "whole", "n").where("conv_id > first")
              .select(F.col("first").alias("chosen_id"), F.col("conv_id").alias("rejected_id"), F.lit("copy").alias("kind")))
    ones = keyed.join(same.select(F.col("first").alias("conv_id")), "conv_id", "left_semi")
    rows = ones.select("conv_id", "silent", F.posexplode("keys").alias("depth", "key"))
    best = (rows.groupBy("key").agg(F.min(F.struct("silent", "conv_id")).alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
            .select("key", F.col("b.conv_id").alias("best"), "n"))
    shared = materialise(spread_join(rows, best, "key", "n").drop("n"), "shared")
    second = shared.where("conv_id <> best").groupBy("key").agg(F.min(F.struct("silent", "conv_id")).alias("b")).select("key", F.col("b.conv_id").alias("second"))
    own = materialise(shared.groupBy("conv_id").agg(F.max(F.struct("depth", "key", "best")).alias("o")).select("conv_id", "o.key", "o.best"), "deepest")
    others = own.where("best <> conv_id").select(F.col("best").alias("chosen_id"), F.col("conv_id").alias("rejected_id"))
    bests = own.where("best = conv_id").join(second, "key").select(F.col("conv_id").alias("chosen_id"), F.col("second").alias("rejected_id"))
    pairs = others.unionByName(bests).distinct().withColumn("kind", F.lit("pair"))
    single = (ones.join(own, "conv_id", "left_anti")
              .select(F.col("conv_id").alias("chosen_id"), F.lit(None).cast(keyed.schema["conv_id"].dataType).alias("rejected_id"), F.lit("single").alias("kind")))
    return pairs.unionByName(copies).unionByName(single)


def preferences(turns: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id, kind, prompt_turns, prompt, chosen, rejected): every conversation is in a row, as chosen or rejected.

    A ``single`` has what comes before the last assistant turn as prompt and the rest as chosen, rejected is null; without an
    assistant all of it is prompt. A ``copy`` has null texts: they are those of chosen_id. Equal lengths of what assistants say
    go to the smaller id. A conversation that is another's beginning has an empty completion. Null texts count as empty in
    what is rendered but are not equal to empty ones; null roles are nobody. Rows without conv_id are left out, repeated rows
    count once, turns with one number go by role and text. Other columns are not looked at. A conversation is one row while
    it is formatted, so its turns have to fit into a task. An empty table gives an empty result.
    """
    convs = materialise(gather(turns), "conversations")
    found = materialise(rivals(convs), "rivals")
    single = found.where("kind = 'single'").join(convs.withColumnRenamed("conv_id", "chosen_id"), "chosen_id")
    spoken = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.coalesce(F.get("turns", i - 1)["role"] == "assistant", F.lit(False)))
    alone = single.withColumn("prompt_turns", F.coalesce(F.array_max(spoken) - 1, F.size("turns")))
    n, all_ = F.col("prompt_turns"), F.col("turns")
    done = alone.select("chosen_id", "rejected_id", "kind", n, render(F.slice(all_, F.lit(1), n)).alias("prompt"), completion(F.slice(all_, n + 1, F.size(all_))).alias("chosen"))
    pairs = found.where("kind = 'pair'")
    wanted = pairs.groupBy("chosen_id").agg(F.count(F.lit(1)).alias("n"))
    left = convs.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("chosen_turns")).join(wanted, "chosen_id")
    right = convs.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("rejected_turns"))
    made = format_pairs(spread_join(pairs, left, "chosen_id", "n").drop("n").join(right, "rejected_id"))
    return made.unionByName(done, allowMissingColumns=True).unionByName(found.where("kind = 'copy'"), allowMissingColumns=True).select(
        "chosen_id", "rejected_id", "kind", "prompt_turns", "prompt", "chosen", "rejected")


def texts(pairs: DataFrame) -> DataFrame:
    """The pieces of completions as texts: each as a whole, and what of it is trained on."""
    def joined(side: str, trained: bool) -> Column:
        pieces = F.filter(side, lambda x: x["train"]) if trained else F.col(side)
        return F.array_join(F.transform(pieces, lambda x: x["text"]), "")

    return pairs.select("chosen_id", "rejected_id", "kind", F.col("prompt_turns").cast("long").alias("prompt_turns"), "prompt",
                        *[joined(side, trained).alias(f"{side}_{name}") for side in ("chosen", "rejected") for name, trained in (("text", False), ("trained", True))])


def oracle() -> str:
    """SQL for ``texts(preferences(conversations))``, on the beginnings themselves in place of digests."""
    def piece(side: str, trained: bool) -> str:
        body = "says" if trained else "true"
        head = "''" if trained else "head"
        return (f"(SELECT coalesce(string_agg(CASE WHEN {body} THEN {head} || body ELSE '' END, '' ORDER BY i), '') FROM t "
                f"WHERE t.conv_id = x.{side}_id AND t.i > x.cut)")

    sides = ", ".join(f"CASE WHEN x.cut IS NOT NULL AND x.{side}_id IS NOT NULL THEN {piece(side, trained)} END AS {side}_{name}"
                      for side in ("chosen", "rejected") for name, trained in (("text", False), ("trained", True)))
    return f"""
WITH d AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i,
        '<|' || coalesce(role, '') || '|>' || chr(10) AS head, coalesce(text, '') || '<|end|>' || chr(10) AS body,
        coalesce(role = 'assistant', false) AS says, coalesce(length(text), 0) AS size,
        coalesce(length(role)::VARCHAR, '-') || ':' || coalesce(role, '') || coalesce(length(text)::VARCHAR, '-') || ':' || coalesce(text, '') AS code FROM d),
c AS (SELECT conv_id, count(*) AS n, sum(CASE WHEN says THEN size ELSE 0 END) AS said, max(CASE WHEN says THEN i END) AS last,
        string_agg(code, '' ORDER BY i) AS whole FROM t GROUP BY conv_id),
ones AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY whole ORDER BY conv_id) = 1),
p AS (SELECT conv_id, said, i, string_agg(code, '') OVER (PARTITION BY conv_id ORDER BY i) AS beginning FROM t JOIN ones USING (conv_id)),
s AS (SELECT *, count(*) OVER w AS m, row_number() OVER (w ORDER BY said DESC, conv_id) AS place FROM p WINDOW w AS (PARTITION BY beginning)),
own AS (SELECT * FROM s WHERE m > 1 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
pairs AS (SELECT DISTINCT CASE WHEN own.place = 1 THEN own.conv_id ELSE o.conv_id END AS chosen_id,
        CASE WHEN own.place = 1 THEN o.conv_id ELSE own.conv_id END AS rejected_id
      FROM own JOIN s o ON o.beginning = own.beginning AND o.place = CASE WHEN own.place = 1 THEN 2 ELSE 1 END),
x AS (SELECT chosen_id, rejected_id, 'pair' AS kind, coalesce((SELECT max(a.i) FROM p a JOIN p b ON a.beginning = b.beginning
        WHERE a.conv_id = pairs.chosen_id AND b.conv_id = pairs.rejected_id), 0) AS cut FROM pairs
      UNION ALL SELECT conv_id, NULL, 'single', coalesce(last - 1, n) FROM ones WHERE conv_id NOT IN (SELECT conv_id FROM own)
      UNION ALL SELECT ones.conv_id, c.conv_id, 'copy', NULL FROM c JOIN ones ON c.whole = ones.whole AND c.conv_id <> ones.conv_id)
SELECT x.chosen_id, x.rejected_id, x.kind, x.cut::BIGINT AS prompt_turns,
  CASE WHEN x.cut IS NOT NULL THEN (SELECT coalesce(string_agg(head || body, '' ORDER BY i), '') FROM t WHERE t.conv_id = x.chosen_id AND t.i <= x.cut) END AS prompt,
  {sides}
FROM x"""
