"""Chat formatting of reply trees.

Messages form trees: each names its parent. Iterative self-joins with doubled steps find root-to-leaf paths: a round
joins every message's ancestor 2^k above it with that one's own, which gives 2^(k+1), and adds up the scores in
between, so that a tree of depth d takes log2(d) rounds of one row a message. Branches are ranked by the mean score of
their messages (then the more messages, then the smaller leaf); only the best ``branches`` of each tree are then
enumerated, along the same ancestors, and become one conversation each.

The template marks a turn as ``<|turn|>role<|says|>text<|done|>``. In roles and texts every ``<|`` becomes ``<\\|``
and every ``<\\`` becomes ``<\\\\``, so that no control string can occur inside and the original is read back exactly.
Loss spans are the code points of assistant texts as formatted.

Defined results: null texts and roles are empty; a message whose parent isn't there starts a tree of its own path; a
message with a null tree or id is a conversation of its own; of messages that share a tree and an id one counts, the
least by parent, score, role and text; turns of one conversation that share a number are ordered by role and text; a null conversation
id is a conversation of its own; a cycle of parents, or a message that hangs on one, raises ValueError; very long texts are handled
one by one; columns beside those named are ignored; an empty table gives an empty one. A conversation is one row of
the result, hence gathered in one task.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, checkpointed, cut, table

TURN, SAYS, DONE = "<|turn|>", "<|says|>", "<|done|>"
_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_PARSED = re.compile(r"<\|turn\|>(.*?)<\|says\|>(.*?)<\|done\|>", re.DOTALL)


def escape(text: str) -> str:
    return text.replace("<\\", "<\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"<\\([\\|])", r"<\1", text)


def format_turns(turns: list[tuple[str, str]], loss_role: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one text, and the spans that count for the loss."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{SAYS}", escape(text)
        at += len(head)
        if role == loss_role:
            spans.append((at, at + len(body)))
        at += len(body) + len(DONE)
        parts += [head, body, DONE]
    return "".join(parts), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(a), unescape(b)) for a, b in _PARSED.findall(formatted)]


def ancestors(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(for k = 0, 1, ...: (tree, id, above), the ancestor 2^k above each message that has one; (tree, id, total, n),
    the sum of scores and the number of messages of the path from each message up to its root).

    ``messages`` has tree, id, parent (null at a root) and score, the first two not null and unique together. Every
    table has at most a row for each message. One of a tree's m messages has at most m - 1 ancestors; more mean that
    it hangs on a cycle, which raises ValueError after log2(m) rounds.
    """
    there = messages.select("tree", F.col("id").alias("parent"), F.lit(True).alias("there"))
    first = messages.select("tree", "id", "parent", "score").join(there, ["tree", "parent"], "left")
    now = checkpointed(first.select("tree", "id", F.when(F.col("there"), F.col("parent")).alias("above"), F.col("score").alias("total"), F.lit(1).cast("long").alias("n")))
    most = messages.groupBy("tree").count().agg(F.max("count")).first()[0] or 1
    levels: list[DataFrame] = []
    for _ in range((most - 1).bit_length() + 1):
        going = now.filter("above IS NOT NULL")
        if going.isEmpty():
            return levels, now.select("tree", "id", "total", "n")
        levels.append(going.select("tree", "id", "above"))
        upper = now.select("tree", F.col("id").alias("above"), F.col("above").alias("next"), F.col("total").alias("more"), F.col("n").alias("m"))
        further = going.join(upper, ["tree", "above"]).select("tree", "id", F.col("next").alias("above"), (F.col("total") + F.col("more")).alias("total"), (F.col("n") + F.col("m")).alias("n"))
        now = checkpointed(now.filter("above IS NULL").unionByName(further))
    raise ValueError("parents form a cycle")


def paths(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(tree, leaf, id, up): all messages of the path of each of ``leaves`` (tree, leaf), ``up`` steps above it. Each
    round adds to the known messages of a path those 2^k above them."""
    found = leaves.select("tree", "leaf", F.col("leaf").alias("id"), F.lit(0).cast("long").alias("up"))
    for k, level in enumerate(levels):
        more = found.join(level, ["tree", "id"]).select("tree", "leaf", F.col("above").alias("id"), (F.col("up") + (1 << k)).alias("up"))
        found = checkpointed(found.unionByName(more))
    return found


def format_trees(messages: DataFrame, branches: int = 1, loss_role: str = "assistant") -> DataFrame:
    """(tree, leaf, n_turns, formatted, loss): the best ``branches`` paths of each tree, formatted.

    ``messages`` has tree, id, parent, role, text and score (null or not a number: 0).
    """
    bound_batches(messages.sparkSession)
    score = F.nanvl(F.coalesce(F.col("score").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("score")
    said = [F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    rows = messages.select("tree", "id", "parent", score, *said)
    loose = F.col("tree").isNull() | F.col("id").isNull()
    # of rows that share an id, one
    whole = rows.filter(~loose).groupBy("tree", "id").agg(F.min(F.struct("parent", "score", "role", "text")).alias("m")).select("tree", "id", "m.*")
    whole = cut(whole)
    levels, summed = ancestors(whole.select("tree", "id", "parent", "score"))
    parents = whole.select("tree", F.col("parent").alias("id")).filter("id IS NOT NULL").distinct()
    leaves = summed.join(parents, ["tree", "id"], "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("n")), F.desc("n"), "id")
    chosen = leaves.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= branches).select("tree", F.col("id").alias("leaf"))
    turns = paths(checkpointed(chosen), levels).join(whole.select("tree", "id", "role", "text"), ["tree", "id"])
    told = turns.groupBy("tree", "leaf").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text"))), lambda s: F.struct(s["role"], s["text"])).alias("turns"))
    told = told.unionByName(rows.filter(loose).select("tree", F.col("id").alias("leaf"), F.array(F.struct("role", "text")).alias("turns")))

    shape = f"tree {messages.schema['tree'].dataType.simpleString()}, leaf {messages.schema['id'].dataType.simpleString()}, n_turns long, formatted string, loss array<struct<start:long,end:long>>"
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(messages.sparkSession.createDataFrame([], shape).schema)

    def run(batches):
        for b in batches:
            step = 500
            for k in range(0, b.num_rows, step):
                part = b.slice(k, step)
                told_ = [[(t["role"], t["text"]) for t in x] for x in part.column("turns").to_pylist()]
                made = [format_turns(t, loss_role) for t in told_]
                yield pa.RecordBatch.from_arrays(
                    [part.column("tree").cast(arrow.field("tree").type), part.column("leaf").cast(arrow.field("leaf").type), pa.array([len(t) for t in told_], pa.int64()), pa.array([m[0] for m in made], pa.string()), pa.array([[{"start": x, "end": y} for x, y in m[1]] for m in made], arrow.field("loss").type)],
                    schema=arrow,
                )

    return told.mapInArrow(run, shape)


def read_back(df: DataFrame, formatted: str = "formatted", loss: str = "loss", keep: tuple[str, ...] = ()) -> DataFrame:
    """Digests of what ``formatted`` says: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    shape = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep) + "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], shape).schema)

    def run(batches):
        for b in batches:
            rows: list[tuple] = []
            for text, spans in zip(b.column(len(keep)).to_pylist(), b.column(len(keep) + 1).to_pylist(), strict=True):
                turns = parse_turns(text)
                lost = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(lost), hashlib.sha256(lost.encode()).hexdigest(), len(text)))
            cols = [pa.array([r[k] for r in rows], arrow.field(len(keep) + k).type) for k in range(5)]
            yield pa.RecordBatch.from_arrays([*(b.column(i).cast(arrow.field(i).type) for i in range(len(keep))), *cols], schema=arrow)

    return df.select(*keep, formatted, loss).mapInArrow(run, shape)


def threads(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Plain conversations as trees: each turn replies to the one before. Keeps conv_id."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = rows.withColumn("id", F.row_number().over(order).cast("long"))
    tree = F.struct(F.col("conv_id").isNull().alias("null"), F.coalesce("conv_id", F.lit(0)).alias("id"))
    return rows.select(tree.alias("tree"), "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(None).cast("double").alias("score"))


#: The conversation that the query adds.
ADDED = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op8_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(ADDED, "conv_id long, turn long, role string, text string"))
    formatted = format_trees(cut(threads(rows)))
    told = formatted.withColumn("conv_id", F.when(~F.col("tree")["null"], F.col("tree")["id"]))
    return read_back(told, keep=("conv_id",))
