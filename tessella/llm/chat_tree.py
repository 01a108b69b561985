"""Chat formatting on a prefix tree: initial turns that conversations share are emitted once.

A turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``. In roles and texts a backslash is doubled, ``<|``
becomes ``<\\|`` and a newline in a role ``\\n``, so that no control string can come from content and all
is reversible. Only assistants' texts are under the loss mask.

Conversations that begin with the same turns share those nodes of a tree. The nodes are laid out depth
first in one packed stream of code points. Each node has its place in the stream, the position of its
first code point within its conversation (position ids run on from there), the loss interval, and the
intervals of its ancestors, which together with its own causal prefix are all it may attend to.

A node's id is the running xor of hashes of (turn number, role, text), so the tree is built by windows
and one aggregation; a first turn that a third of all conversations share is one row after map-side
aggregation. The depth-first layout is a range partitioning by path. What crosses partitions, a stack of
ancestors and a running length, is one row a partition.

A conversation is laid out by its path of hashes and read back in one row, so its number of turns is
bounded by a row's size; the number of conversations and of those that share a turn is not.

Defined results: null text and role act as empty; turns go by number, nulls first, ties by role and
text; repeated rows are repeated turns; rows with a null conversation are one conversation; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.runtime import shared_dir

START, END = "<|im_start|>", "<|im_end|>\n"
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def _escape(c):
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, k, h, id0, id1, path, segment, size, position, loss_start, loss_end) of every turn."""
    rows = conversations.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.concat(F.lit(START), F.replace(_escape(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    body = _escape(F.col("text"))
    rows = rows.withColumn("k", F.row_number().over(order)).withColumns(
        {
            "segment": F.concat(head, body, F.lit(END)),
            "loss_start": F.when(F.col("role") == "assistant", F.length(head)),
            "loss_end": F.when(F.col("role") == "assistant", F.length(head) + F.length(body)),
            "h0": F.xxhash64("k", "role", "text"), "h1": F.xxhash64(F.lit("second"), "k", "role", "text"),
        }
    )
    rows = rows.withColumns({"id0": F.bit_xor("h0").over(upto), "id1": F.bit_xor("h1").over(upto), "size": F.length("segment").cast("long")})
    return rows.select(
        "conv", "k", "id0", "id1", F.collect_list("h0").over(upto).alias("path"), "segment", "size",
        (F.sum("size").over(upto) - F.col("size")).alias("position"), "loss_start", "loss_end",
    )


def _follow(stack: list, depth: int, node: tuple[int, int, int]) -> None:
    del stack[depth:]
    stack.append(node)


def _ends(batches):
    """One row a partition: its number, its length, and the stack after its last node, with starts
    relative to the partition; ancestors from earlier partitions are left as missing."""
    stack: list = []
    at = 0
    for batch in batches:
        for depth, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            stack += [None] * (depth - len(stack))
            _follow(stack, depth, (at, size))
            at += size
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([at], pa.int64()),
            pa.array([[x[0] if x else None for x in stack]], pa.list_(pa.int64())), pa.array([[x[1] if x else None for x in stack]], pa.list_(pa.int64())),
        ],
        names=["part", "length", "starts", "sizes"],
    )


def _carried(ends: list) -> dict[int, tuple[int, list[tuple[int, int]]]]:
    """Where each partition starts in the stream, and the stack of nodes before it."""
    out, at, stack = {}, 0, []
    for r in sorted(ends, key=lambda r: r["part"]):
        out[r["part"]] = (at, list(stack))
        if r["length"]:
            own = [(at + s, n) if s is not None else None for s, n in zip(r["starts"], r["sizes"], strict=True)]
            stack = [x or stack[k] for k, x in enumerate(own)]
        at += r["length"]
    return out


def _layout(carried: dict[int, tuple[int, list[tuple[int, int]]]]):
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        at, stack = carried[TaskContext.get().partitionId()]
        stack = list(stack)
        for batch in batches:
            starts, above = [], []
            for depth, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _follow(stack, depth, (at, size))
                starts.append(at)
                above.append([{"start": s, "end": s + n} for s, n in stack[:-1]])
                at += size
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts, pa.int64()), pa.array(above, spans)], names=[*batch.schema.names, "start", "ancestors"])

    return run


def pack(turn_rows: DataFrame) -> DataFrame:
    """Nodes in depth-first order: (depth, size, id0, id1, segment, position, loss_start, loss_end,
    start, ancestors); ``start`` and ``ancestors`` are places in the packed stream."""
    shared_dir(turn_rows.sparkSession)
    same = ["path", "segment", "size", "position", "loss_start", "loss_end"]
    nodes = turn_rows.groupBy("id0", "id1").agg(*(F.first(c).alias(c) for c in same)).withColumn("depth", F.size("path") - 1)
    # the last order of a path's nodes is by id: two ids never share a path but by a collision
    ordered = nodes.repartitionByRange("path", "id1").sortWithinPartitions("path", "id1")
    ordered = ordered.select("depth", "size", "id0", "id1", "segment", "position", "loss_start", "loss_end").checkpoint()
    ends = ordered.select("depth", "size").mapInArrow(_ends, "part int, length long, starts array<long>, sizes array<long>").collect()
    schema = ", ".join(f"{n} {t}" for n, t in ordered.dtypes) + ", start long, ancestors array<struct<start:long,end:long>>"
    return ordered.mapInArrow(_layout(_carried(ends)), schema)


def read_back(turn_rows: DataFrame, packed: DataFrame) -> DataFrame:
    """(conv, segments, losses): what the packed stream holds for each conversation, found from its
    last node and that node's ancestor intervals alone."""
    last = turn_rows.groupBy("conv").agg(F.max(F.struct("k", "id0", "id1")).alias("x")).select("conv", "x.id0", "x.id1")
    leaf = last.join(packed.select("id0", "id1", "start", "ancestors"), ["id0", "id1"])
    starts = F.concat(F.transform("ancestors", lambda a: a["start"]), F.array("start"))
    wanted = leaf.select("conv", F.explode(starts).alias("start"))
    parts = wanted.join(packed.select("start", "segment", "position", "loss_start", "loss_end"), "start")
    return parts.groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("position", "segment", "loss_start", "loss_end"))).alias("parts")
    )


def _reports(batches):
    for batch in batches:
        rows = []
        for parts in batch.column(1).to_pylist():
            text = "".join(p["segment"] for p in parts)
            found = [(unescape(r), unescape(t)) for r, t in _TURN.findall(text)]
            if "".join(START + r + "\n" + t + END for r, t in _TURN.findall(text)) != text:
                raise ValueError("a packed conversation does not parse")
            loss = "".join(unescape(p["segment"][p["loss_start"] : p["loss_end"]]) for p in parts if p["loss_start"] is not None)
            digest = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
            rows.append((len(found), digest("".join(f"{r}\n{t}\n" for r, t in found)), len(loss), digest(loss), len(text)))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
            names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )


def format_report(conversations: DataFrame) -> DataFrame:
    """Packs ``conversations`` and reports, from the packed output, on each of them."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = turns(conversations)
    back = read_back(rows, pack(rows))
    return back.mapInArrow(
        _reports, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
