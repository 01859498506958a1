"""Chat formatting on a prefix tree (operator 7).

A turn is written `<|im_start|>role<|im_sep|>text<|im_end|>`. Roles and texts are escaped: a backslash becomes
two, and inside each control string a backslash follows its first character, so no control string can come out of
a text, and dropping those backslashes gives the text back.

Conversations that share initial turns share nodes of one tree. Rows are sorted by their turns' hashes, so those
that share turns stand together, and a walk over them is the tree depth first. All nodes make one stream of tokens, each
node once, however many conversations go through it; packs are pieces of that stream, and their tokens' places are counted
through. A node has its start and end in the stream, its parent (by its start), and where the loss counts its tokens; each
token has its position id, its place on its own path. A node attends to itself and to its ancestors: `attends` lists
their intervals in the stream. Ancestors may stand in an earlier pack: `context` names those that a pack goes on from, and
read_back fetches their tokens from there. Which nodes are open where one task's rows end and the next one's begin is
settled on the driver, from one row a task (the first and the last path).

Tokens are code points unless another tokenizer is given; head, text and end of a turn are encoded apart.

Defined cases: turns go by number, null first, then by role and text; a null role or text is empty; repeated rows
are repeated turns; rows with a null conversation id form one conversation; a conversation has one path however
many turns it has; an empty table gives no packs; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from ._base import materialize, releasing, small_batches, table

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Control strings of the template and of other templates that a tokenizer may know.
CONTROL = (START, SEP, END, "<|endoftext|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)))
_MARKS = re.compile(f"{re.escape(START)}|{re.escape(SEP)}|{re.escape(END)}")
_DROP = re.compile(r"\\(.)", re.S)
LOSS_ROLE = "assistant"
#: Tokens of ancestors, over all packs that go on from them, up to which they are broadcast (16 MB).
BROADCAST_TOKENS = 4_000_000
#: A row may have some MB, and Spark's reader takes up to 4,096 rows of a row group at once, decoded. So row groups end by their rows,
#: or by their bytes after any row; by default the first 100 rows are one group, whatever they hold.
CONVERSATIONS, PACKS = ({"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1", "parquet.block.row.count.limit": str(n)} for n in (64, 8))


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _DROP.sub(r"\1", text)


def format_turn(role: str, text: str) -> str:
    return f"{START}{escape(role)}{SEP}{escape(text)}{END}"


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """Turns of a formatted conversation: role, text, and where its escaped text starts and ends."""
    out, role, at = [], "", 0
    for m in _MARKS.finditer(formatted):
        if m[0] == START:
            at = m.end()
        elif m[0] == SEP:
            role, at = unescape(formatted[at : m.start()]), m.end()
        else:
            out.append((role, unescape(formatted[at : m.start()]), at, m.start()))
    return out


class CodePoints:
    """Each character is a token."""

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.int32)

    def decode(self, tokens: np.ndarray) -> str:
        return np.asarray(tokens, dtype="<i4").tobytes().decode("utf-32-le", "replace")


_NODE = "struct<start:long,end:long,position:long,parent:long,loss:boolean,loss_start:long,loss_end:long"
_FIELDS = ("start", "end", "position", "parent", "loss", "loss_start", "loss_end")


class Walk:
    """The tree as sorted conversations come by: a new path leaves the last one at some depth for good."""

    def __init__(self, tokenizer, offset: int = 0):
        self.tokenizer, self.offset = tokenizer, offset
        self.path: list[tuple[tuple[str, str], tuple, list]] = []  # turn, node and attended intervals along the last path
        self.first: list[tuple] = []
        self._cut()

    def _cut(self) -> None:
        self.tokens: list[np.ndarray] = []
        self.begin, self.nodes, self.leaves = self.offset, [], []
        self.context = [node for _, node, _ in self.path]

    def open(self, turns: list[tuple[str, str]], nodes: list[tuple]) -> None:
        """Nodes of the first path that an earlier task has emitted."""
        for turn, node in zip(turns, nodes, strict=False):
            self._step(turn, node)
        self._cut()

    def _step(self, turn: tuple[str, str], node: tuple) -> None:
        own = list(self.path[-1][2]) if self.path else []
        if own and own[-1][1] == node[0]:  # it goes on where its parent ends
            own[-1] = (own[-1][0], node[1])
        else:
            own.append((node[0], node[1]))
        self.path.append((turn, node, own))

    def shared(self, turns: list[tuple[str, str]]) -> int:
        depth = 0
        while depth < min(len(turns), len(self.path)) and self.path[depth][0] == turns[depth]:
            depth += 1
        return depth

    def add(self, conv: object, turns: list[tuple[str, str]]) -> None:
        del self.path[self.shared(turns) :]
        for role, text in turns[len(self.path) :]:
            parts = [self.tokenizer.encode(x) for x in (START + escape(role) + SEP, escape(text), END)]
            size, loss = sum(map(len, parts)), role == LOSS_ROLE
            parent = self.path[-1][1] if self.path else None
            inside = self.offset + len(parts[0])
            span = (inside, inside + len(parts[1])) if loss else (0, 0)
            node = (self.offset, self.offset + size, parent[2] + parent[1] - parent[0] if parent else 0, parent[0] if parent else -1, loss, *span)
            self._step((role, text), node)
            self.tokens += parts
            self.nodes.append((node, self.path[-1][2]))
            self.offset += size
        self.leaves.append((conv, self.path[-1][1][0] if self.path else -1))

    def pack(self, turns: list[tuple[str, str]] | None = None) -> dict:
        """What has come so far, as a row; the next pack goes on from what the next conversation shares."""
        positions = [np.arange(n[2], n[2] + n[1] - n[0], dtype=np.int32) for n, _ in self.nodes]
        none = np.zeros(0, dtype=np.int32)
        row = {
            "begin": self.begin,
            "tokens": np.concatenate([none, *self.tokens]).astype(np.int32),
            "positions": np.concatenate([none, *positions]),
            "nodes": [dict(zip(_FIELDS, n, strict=True)) | {"attends": [{"start": a, "end": b} for a, b in x]} for n, x in self.nodes],
            "conversations": [{"conv_id": c, "leaf": leaf} for c, leaf in self.leaves],
            "context": [dict(zip(_FIELDS, n, strict=True)) for n in self.context],
        }
        del self.path[self.shared(turns or []) :]
        self._cut()
        return row


def _mark(turn: tuple[str, str]) -> bytes:
    return hashlib.blake2b("\0".join(turn).encode("utf-8", "replace"), digest_size=16).digest()


def _carried(tasks: list) -> dict[int, tuple[int, list[tuple]]]:
    """For each task, in order: where its part of the stream begins, and the nodes of its first path that are there already."""
    out: dict[int, tuple[int, list[tuple]]] = {}
    offset, open_ = 0, []
    for t in tasks:
        first, last = t["first"], t["last"]
        depth = 0
        while depth < min(len(first), len(open_)) and first[depth]["mark"] == open_[depth][0]:
            depth += 1
        context = [node for _, node in open_[:depth]]
        out[t["task"]] = (offset, context)
        had = first[depth - 1]["node"]["end"] if depth else 0  # what the task itself counted for them
        now = []
        for x in last:
            n = tuple(x["node"])
            if n[0] < had:
                now.append((x["mark"], context[len(now)]))
            else:
                move = offset - had
                parent = now[-1][1][0] if now else -1
                now.append((x["mark"], (n[0] + move, n[1] + move, n[2], parent, n[4], *((n[5] + move, n[6] + move) if n[4] else (0, 0)))))
        offset, open_ = offset + t["size"] - had, now
    return out


def packs(rows: DataFrame, pack_tokens: int = 1 << 18, pack_rows: int = 1 << 16, tokenizer=CodePoints()) -> DataFrame:
    """Packs of the turns in rows (conv_id, turn, role, text): begin, tokens, positions, nodes, conversations (conv_id, leaf: the start of its last node), context."""
    spark = rows.sparkSession
    small_batches(spark)
    kind = rows.schema["conv_id"].dataType.simpleString()
    turn = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    convs = convs.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    convs = convs.withColumn("path", F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"])))
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # the id breaks ties, so that copies of one conversation don't make one partition
    sorted_ = convs.repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id").select("conv_id", "turns")
    id_type, end = to_arrow_type(rows.schema["conv_id"].dataType), f"array<struct<mark:binary,node:{_NODE}>>>"
    info = f"struct<task:int,size:long,first:{end},last:{end}>"

    def pairs(turns: list) -> list[tuple[str, str]]:
        return [(t["role"], t["text"]) for t in turns]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, place, walk, first = TaskContext.get().partitionId(), 0, Walk(tokenizer), None
        for b in batches:
            for turns in b.column(1).to_pylist():
                walk.add(None, pairs(turns))
                if first is None:
                    first = list(walk.path)
                walk.tokens, walk.nodes, walk.leaves = [], [], []  # only sizes count here
            k = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([task] * k, pa.int32()), pa.array(np.arange(place, place + k)), b.column(0), b.column(1), pa.nulls(k, info_type)], names=names)
            place += k
        if first is not None:
            ends = {"first": first, "last": walk.path}
            told = {"task": task, "size": walk.offset} | {key: [{"mark": _mark(t), "node": dict(zip(_FIELDS, node, strict=True))} for t, node, _ in path] for key, path in ends.items()}
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([-1], pa.int64()), pa.nulls(1, id_type), pa.nulls(1, turns_type), pa.array([told], info_type)], names=names)

    names = ["task", "place", "conv_id", "turns", "info"]
    turns_type, info_type = to_arrow_type(sorted_.schema["turns"].dataType), to_arrow_type(_parse_datatype_string(info))
    numbered = materialize(sorted_.mapInArrow(releasing(number), f"task int, place long, conv_id {kind}, turns array<struct<role:string,text:string>>, info {info}"), CONVERSATIONS)
    carried = _carried([r["info"] for r in numbered.filter("place = -1").select("info").orderBy("info.task").collect()])  # a row for each task
    sent = spark.sparkContext.broadcast(carried)
    schema = f"begin long, tokens array<int>, positions array<int>, nodes array<{_NODE},attends:array<struct<start:long,end:long>>>>, conversations array<struct<conv_id:{kind},leaf:long>>, context array<{_NODE}>>"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, walk = None, None

        def row(turns: list | None = None) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([walk.pack(turns)], schema=arrow)

        for b in batches:
            for t, conv, turns in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                path = pairs(turns)
                if t != task:
                    if walk:
                        yield row()
                    task, walk = t, Walk(tokenizer, sent.value[t][0])
                    walk.open(path, sent.value[t][1])
                elif walk.offset - walk.begin >= pack_tokens or len(walk.leaves) >= pack_rows:
                    yield row(path)
                walk.add(conv, path)
        if walk:
            yield row()

    dealt = numbered.filter("place >= 0").repartitionById(n, F.col("task")).sortWithinPartitions("task", "place").select(names[:4])
    return materialize(dealt.mapInArrow(releasing(emit), schema), PACKS)


def _with_ancestors(packed: DataFrame) -> DataFrame:
    """The packs with `before`: the tokens of each node in their context, from the packs that hold them."""
    asked = packed.select("begin", F.explode("context").alias("c")).select(F.col("begin").alias("by"), "c.start", "c.end")
    total = asked.agg(F.sum(F.col("end") - F.col("start"))).first()[0] or 0
    near = F.broadcast if total <= BROADCAST_TOKENS else (lambda df: df)  # beyond, the packs are dealt by their beginnings
    held = packed.select("begin", F.explode("nodes.start").alias("start"))
    wanted = asked.select("start", "end").distinct().join(held, "start").groupBy("begin").agg(F.collect_list(F.struct("start", "end")).alias("w"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin, tokens, w in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                got = tokens.values.to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([x["start"] for x in w], pa.int64()), pa.array([got[x["start"] - begin : x["end"] - begin] for x in w], pa.list_(pa.int32()))], names=["start", "tokens"])

    found = packed.select("begin", "tokens").join(near(wanted), "begin").mapInArrow(releasing(take), "start long, tokens array<int>")
    before = asked.join(near(found), "start").groupBy(F.col("by").alias("begin")).agg(F.collect_list(F.struct("start", "tokens")).alias("before"))
    return packed.join(near(before), "begin", "left")


def read_back(packed: DataFrame, tokenizer=CodePoints()) -> DataFrame:
    """A row for each conversation, from the packs alone: its turns, the loss text and the length of its formatted text, as digests."""
    kind = packed.schema["conversations"].dataType.elementType["conv_id"].dataType
    made = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin, tokens, nodes, convs, context, before in zip(b.column(0).to_pylist(), b.column(1), *(b.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                parts = [(x["start"], np.asarray(x["tokens"], dtype=np.int32)) for x in before or []]
                parts = sorted([*parts, (begin, tokens.values.to_numpy(zero_copy_only=False))], key=lambda p: p[0])
                starts = [p[0] for p in parts]
                by_start = {n["start"]: n for n in [*context, *nodes]}

                def text(a: int, z: int) -> str:
                    out = []
                    while a < z:
                        start, own = parts[bisect_right(starts, a) - 1]
                        stop = min(z, start + len(own))
                        out.append(own[a - start : stop - start])
                        a = stop
                    return tokenizer.decode(np.concatenate(out)) if out else ""

                known: dict[int, tuple] = {}
                rows = []
                for c in convs:
                    if c["leaf"] not in known:
                        chain, k = [], c["leaf"]
                        while k >= 0:
                            chain.append(by_start[k])
                            k = chain[-1]["parent"]
                        at = by_start[c["leaf"]]
                        spans = [(x["start"], x["end"]) for x in at.get("attends") or reversed(chain)]
                        formatted = "".join(text(*x) for x in spans)
                        turns = parse(formatted)
                        loss = "".join(unescape(text(x["loss_start"], x["loss_end"])) for x in reversed(chain) if x["loss"])
                        known = {c["leaf"]: (len(turns), sha("".join(f"{r}\n{t}\n" for r, t, _, _ in turns)), len(loss), sha(loss), len(formatted))}
                    rows.append(known[c["leaf"]])
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([c["conv_id"] for c in convs], to_arrow_type(kind)), *(pa.array(v, t) for v, t in zip(cols, types, strict=True))], names=["conv_id", *made])

    src = _with_ancestors(packed).select("begin", "tokens", "nodes", "conversations", "context", "before")
    return src.mapInArrow(releasing(run), f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op7_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    return read_back(packs(rows.unionByName(extra)))


_ESC = "replace({}, chr(92), chr(92) || chr(92))"
for _c in sorted(CONTROL, key=len, reverse=True):
    _ESC = f"replace({_ESC}, '{_c}', '{_c[0]}' || chr(92) || '{_c[1:]}')"
ORACLE = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS t,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS l,
  sum(length({_ESC.format('role')}) + length({_ESC.format('text')}) + {len(START + SEP + END)}) AS f FROM c GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(t) AS turns_sha256, CAST(length(l) AS BIGINT) AS loss_chars, sha256(l) AS loss_sha256, CAST(f AS BIGINT) AS formatted_chars FROM a"""

QUERIES = {"op7_chat_format": op7_chat_format}
ORACLES = {"op7_chat_format": ORACLE}
