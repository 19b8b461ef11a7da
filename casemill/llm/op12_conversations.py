"""Cheapest repair of conversation structure by a Viterbi search that runs on chunks of rows in parallel.

The role initials of a repaired conversation read ``(s?(ua)+)?``: a system turn at most, then user and assistant in turn. A row is kept
(cost 0), gets the role user or assistant (3) or goes (4; blank and duplicate rows must); empty user or assistant turns are
inserted anywhere (3 each); a truncated row that stays costs 3 more. Of the cheapest repairs the one whose edits' initials
(D, I, K, R) come first in ASCII is taken.

1. Equal rows are counted, the first turn of each text and role is joined back, and rows are dealt by ranges of (conversation,
   turn), so that a long conversation is many tasks' work; each range is cut into chunks of at most ``chunk`` rows. Chunks are
   written, and numbered through.
2. Costs to the end are vectors over four states (start, after s, u, a). Each chunk runs backwards from a vector of zeros, as
   if anything could follow it, but for the last of a conversation, whose costs at the end are known. Steps are (min, +) products,
   which soon forget where they started up to a constant: fix-up passes give each chunk the vector its successor begins with, and rerun it only
   until it meets a vector that differs from its own by a constant. Vectors are kept less their minimum, so that this
   is equality; passes end when no chunk's end changes, and the result is that of one run over everything.
3. Forwards, a chunk maps each of four states to the one it leaves; maps are composed over a conversation's chunks by
   doubling distances. From its true state each chunk then traces the edits, by costs to the end: of equal ones the least.

Defined results: a null role or text is one space (a blank row); rows come by turn, those without one first, then by role and text; equal rows stand together, and all but the
first are duplicates; an initial is a role's first character, roles that begin with no s, u or a can't be kept; a null
conversation is one of its own; an empty table returns no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.llm.common import cut, small_batches, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, after s, after u, after a. The turn that an insertion adds, and the state after it.
INSERTED, AFTER = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
#: Costs to the end where no row is left: insertions that complete the last pair.
END = np.array([0, 6, 3, 0], np.int64)
INITIALS = "sua"
NONE, BLANK, DUPLICATE, CUT_SHORT = range(4)
FAR = 1 << 20
#: Bytes of text in a chunk.
BYTES = 4 << 20


def _options() -> tuple[np.ndarray, np.ndarray, list[list[list[str]]]]:
    """cost, next state and letters of what can be done with a row of a code (role's kind * 4 + fault) in a state, by letters."""
    cost, after = np.full((16, 4, 9), FAR, np.int64), np.zeros((16, 4, 9), np.int64)
    letters: list[list[list[str]]] = [[[] for _ in range(4)] for _ in range(16)]
    for code in range(16):
        kind, fault = divmod(code, 4)
        for state in range(4):
            found, t = [], state
            for k in range(3):
                found.append(("I" * k + "D", INSERT * k + DELETE, t))
                if fault not in (BLANK, DUPLICATE):
                    worse = TRUNCATED if fault == CUT_SHORT else 0
                    if (kind, t) in ((0, 0), (1, 0), (1, 1), (1, 3), (2, 2)):
                        found.append(("I" * k + "K", INSERT * k + KEEP + worse, kind + 1))
                    found.append(("I" * k + "R", INSERT * k + REROLE + worse, AFTER[t]))
                t = AFTER[t]
            for i, (text, c, n) in enumerate(sorted(found)):
                cost[code, state, i], after[code, state, i] = c, n
                letters[code][state].append(text)
    return cost, after, letters


COST, NEXT, LETTERS = _options()


def _padded(codes: list[bytes], from_end: bool) -> np.ndarray:
    """Codes as rows of one array; -1 where a chunk is shorter."""
    n = max(map(len, codes))
    out = np.full((len(codes), n), -1, np.int64)
    for row, c in zip(out, codes, strict=True):
        if c:
            row[n - len(c) if from_end else 0 :][: len(c)] = np.frombuffer(c, np.uint8)
    return out


def backward(codes: list[bytes], ends: np.ndarray, old: list[bytes] | None = None) -> list[bytes]:
    """Costs to the end before each row of each chunk and behind it, less their least: (rows + 1) * 4 bytes.

    With the vectors of an earlier run, a chunk stops where it meets one of them: what stands before stays as it is.
    """
    c = _padded(codes, True)
    n = c.shape[1]
    v = ends - ends.min(1, keepdims=True)
    out = np.zeros((len(codes), n + 1, 4), np.uint8)
    for row, k, o in zip(out, codes, old or (), strict=False):
        row[n - len(k) :] = np.frombuffer(o, np.uint8).reshape(-1, 4)
    out[:, n] = v
    live = np.arange(len(codes))
    for j in range(n - 1, -1, -1):
        live = live[c[live, j] >= 0]
        k = c[live, j]
        w = (COST[k] + v[live[:, None, None], NEXT[k]]).min(2)
        w -= w.min(1, keepdims=True)
        if old is not None:
            new = (w != out[live, j]).any(1)
            live, w = live[new], w[new]
        if not len(live):
            break
        v[live] = w
        out[live, j] = w
    return [x[n - len(k) :].tobytes() for x, k in zip(out, codes, strict=True)]


def forward(codes: list[bytes], vectors: list[bytes], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The states that chunks leave, entered in each of starts (chunks, m), and the option taken at each row: (chunks, rows, m)."""
    c = _padded(codes, False)
    b = np.zeros((len(codes), c.shape[1] + 1, 4), np.int64)
    for row, x in zip(b, vectors, strict=True):
        x = np.frombuffer(x, np.uint8).reshape(-1, 4)
        row[: len(x)] = x
    state = starts.astype(np.int64).copy()
    taken = np.zeros((*c.shape, starts.shape[1]), np.uint8)
    for j in range(c.shape[1]):
        live = np.flatnonzero(c[:, j] >= 0)
        k, s = c[live, j][:, None], state[live]
        ahead = NEXT[k, s]
        best = (COST[k, s] + b[live[:, None, None], j + 1, ahead]).argmin(2)
        taken[live, j] = best
        state[live] = np.take_along_axis(ahead, best[:, :, None], 2)[:, :, 0]
    return state, taken


def _rows(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> distinct rows, how often they occur (n), and the first one's code."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    role = F.coalesce(F.col("role").cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text")).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    rows = rows.withColumn("key", F.sha2(F.col("text").cast("binary"), 256))
    first = rows.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("key").alias("k")).agg(F.min(F.struct("turn")).alias("first"))
    x = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("key") == F.col("k")))
    again = ~F.col("turn").eqNullSafe(F.col("first.turn"))
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(again, DUPLICATE).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), CUT_SHORT).otherwise(NONE)
    kind = F.lit(len(INITIALS))
    for i, letter in enumerate(INITIALS):
        kind = F.when(F.col("role").startswith(letter), i).otherwise(kind)
    return x.select("conv_id", "turn", "role", "text", "n", fault.alias("fault"), kind.cast("int").alias("kind"))


def _chunks(rows: DataFrame, chunk: int) -> DataFrame:
    """rows in the order of conversations and turns -> conv_id, part, seq, codes, roles, texts (of the rows that may stay)."""
    conv = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: dict = {}

        def settle() -> pa.RecordBatch:
            nonlocal held, seq
            out = pa.RecordBatch.from_arrays(
                [pa.array([held["conv"]], kind), pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([bytes(held["codes"])], pa.binary()), pa.array([held["roles"]], pa.list_(pa.string())), pa.array([held["texts"]], pa.list_(pa.string()))],
                names=["conv_id", "part", "seq", "codes", "roles", "texts"],
            )
            held, seq = {}, seq + 1
            return out

        for b in batches:
            kind = b.schema.field("conv_id").type
            for c, role, text, n, fault, k in zip(*(b.column(x).to_pylist() for x in ("conv_id", "role", "text", "n", "fault", "kind")), strict=True):
                if held and held["conv"] != c:
                    yield settle()
                for i in range(n):
                    if held and (len(held["codes"]) >= chunk or held["size"] > BYTES):
                        yield settle()
                    held = held or {"conv": c, "codes": bytearray(), "roles": [], "texts": [], "size": 0}
                    own = DUPLICATE if i and fault != BLANK else fault
                    held["codes"].append(4 * k + own)
                    held["roles"].append(role)
                    held["texts"].append(None if own in (BLANK, DUPLICATE) else text)
                    held["size"] += len(text) if own in (NONE, CUT_SHORT) else 0
        if held:
            yield settle()

    order = ["conv_id", "turn", "role", "text"]
    dealt = rows.repartitionByRange("conv_id", "turn", "role", F.xxhash64("text")).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, f"conv_id {conv}, part int, seq long, codes binary, roles array<string>, texts array<string>")


def _numbered(chunks: DataFrame) -> DataFrame:
    """Chunks get their place g among all, in order, and the place of the next in the same conversation, if any."""
    counts = sorted((r["part"], r["n"]) for r in chunks.groupBy("part").agg(F.count("*").alias("n")).collect())  # one for each partition
    base, at = [], 0
    for part, n in counts:
        base.append((part, at))
        at += n
    offsets = chunks.sparkSession.createDataFrame(base, "part int, base long")
    x = chunks.join(F.broadcast(offsets), "part").withColumn("g", F.col("base") + F.col("seq")).drop("base", "part", "seq")
    near = x.select((F.col("g") - 1).alias("g"), F.col("conv_id").alias("c"), F.lit(True).alias("has_next"))
    before = x.select((F.col("g") + 1).alias("g"), F.col("conv_id").alias("d"), F.lit(True).alias("has_prev"))
    x = x.join(near, (x["g"] == near["g"]) & x["conv_id"].eqNullSafe(near["c"]), "left").drop(near["g"]).drop("c")
    x = x.join(before, (x["g"] == before["g"]) & x["conv_id"].eqNullSafe(before["d"]), "left").drop(before["g"]).drop("d")
    return x.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_next", "has_prev")})


def _arrow(df: DataFrame, schema: str, work) -> DataFrame:
    """Rows of g, computed by work from lists of the columns of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_pydict({"g": b.column("g"), **work({c: b.column(c).to_pylist() for c in b.schema.names})})

    return df.mapInArrow(run, f"g long, {schema}")


def costs_to_end(chunks: DataFrame) -> DataFrame:
    """chunks(g, codes, has_next) -> g, vectors: of each chunk as if all rows had been run in one go."""
    first = _arrow(chunks.select("g", "codes", "has_next"), "vectors binary", lambda x: {"vectors": pa.array(backward(x["codes"], np.stack([np.zeros(4, np.int64) if n else END for n in x["has_next"]])), pa.binary())})
    state = cut(first)
    if chunks.filter("has_next").isEmpty():
        return state
    begin = F.substring("vectors", 1, 4)
    while True:
        ahead = state.select((F.col("g") - 1).alias("g"), begin.alias("true_end"))
        x = chunks.filter("has_next").select("g", "codes").join(state, "g").join(ahead, "g").filter(F.expr("substring(vectors, -4, 4) <> true_end"))
        fixed = cut(_arrow(x, "fixed binary", lambda x: {"fixed": pa.array(backward(x["codes"], np.stack([np.frombuffer(e, np.uint8).astype(np.int64) for e in x["true_end"]]), x["vectors"]), pa.binary())}))
        if fixed.isEmpty():
            return state
        state = cut(state.join(fixed, "g", "left").select("g", F.coalesce("fixed", "vectors").alias("vectors")))


def entered(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """chunks(g, codes, has_next, has_prev), vectors -> g, state: the state in which each chunk that isn't its conversation's first is entered."""

    def maps(x: dict) -> dict:
        left, _ = forward(x["codes"], x["vectors"], np.tile(np.arange(4), (len(x["g"]), 1)))
        left = np.where(np.array(x["has_prev"])[:, None], left, left[:, :1])  # a conversation begins in state 0
        return {"m": pa.array(left.tolist(), pa.list_(pa.int64()))}

    many = chunks.filter("has_next or has_prev").select("g", "codes", "has_prev").join(vectors, "g")
    m = cut(_arrow(many, "m array<long>", maps))
    d = 1
    settled = F.array_size(F.array_distinct("m")) == 1
    while not m.filter(~settled).isEmpty():
        before = m.select((F.col("g") + d).alias("g"), F.col("m").alias("before"))
        m = cut(m.join(before, "g", "left").select("g", F.when(settled | F.col("before").isNull(), F.col("m")).otherwise(F.transform("before", lambda s: F.get("m", s.cast("int")))).alias("m")))
        d *= 2
    return chunks.filter("has_prev").select("g").join(m.select((F.col("g") + 1).alias("g"), F.get("m", F.lit(0)).alias("state")), "g")


def repair(turns: DataFrame, *, chunk: int = 512) -> DataFrame:
    """turns(conv_id, turn, role, text) -> one row per chunk of a conversation: conv_id, g (chunks of a conversation in order), codes, the
    letters of the edits, their cost, and roles and texts of the repaired turns; initials of the given ones."""
    small_batches(turns.sparkSession)
    rows = cut(_rows(turns))
    chunks = cut(_numbered(cut(_chunks(rows, chunk))))
    vectors = costs_to_end(chunks)
    states = cut(entered(chunks, vectors))
    x = chunks.join(vectors, "g").join(states, "g", "left")
    conv = rows.schema["conv_id"].dataType.simpleString()

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = {c: b.column(c).to_pylist() for c in b.schema.names if c != "conv_id"}
            start = np.array([s or 0 for s in x["state"]])
            _, taken = forward(x["codes"], x["vectors"], start[:, None])
            out: dict[str, list] = {k: [] for k in ("edits", "cost", "new_roles", "new_texts", "initials")}
            for k, codes in enumerate(x["codes"]):
                state, cost, letters, roles, texts = int(start[k]), 0, [], [], []
                for j, code in enumerate(codes):
                    option = int(taken[k, j, 0])
                    done = LETTERS[code][state][option]
                    letters.append(done)
                    cost += int(COST[code, state, option])
                    t = state
                    for _ in done[:-1]:
                        roles.append(INSERTED[t])
                        texts.append("")
                        t = AFTER[t]
                    if done[-1] != "D":
                        roles.append(x["roles"][k][j] if done[-1] == "K" else INSERTED[t])
                        texts.append(x["texts"][k][j])
                    state = int(NEXT[code, state, option])
                while not x["has_next"][k] and state in (1, 2):
                    letters.append("I")
                    cost += INSERT
                    roles.append(INSERTED[state])
                    texts.append("")
                    state = AFTER[state]
                for name, v in zip(out, ("".join(letters), cost, roles, texts, [r[:1] for r in x["roles"][k]]), strict=True):
                    out[name].append(v)
            kinds = (pa.string(), pa.int64(), *[pa.list_(pa.string())] * 3)
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("g"), b.column("codes"), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], names=["conv_id", "g", "codes", *out])

    done = x.select("conv_id", "g", "codes", "vectors", "state", "has_next", "roles", "texts").mapInArrow(trace, f"conv_id {conv}, g long, codes binary, edits string, cost long, new_roles array<string>, new_texts array<string>, initials array<string>")
    return done.withColumnsRenamed({"new_roles": "roles", "new_texts": "texts"})


def summary(repaired: DataFrame) -> DataFrame:
    """repair()'s rows -> one row per conversation: how many rows were blank, duplicate, truncated, how many neighbours had an illegal
    order, the cost, the edits' letters and the sha256 of the repaired lines.

    A digest needs a conversation's lines in order: they stream through one task, sorted, which holds no more than a batch and the letters.
    """
    conv = repaired.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict = {}

        def settle() -> pa.RecordBatch:
            n = own["n"]
            return pa.RecordBatch.from_arrays([pa.array([own["conv"]], kind), *(pa.array([int(v)], pa.int64()) for v in (n[BLANK], n[DUPLICATE], n[CUT_SHORT], own["illegal"], own["cost"])), pa.array(["".join(own["audit"])]), pa.array([own["hash"].hexdigest()])], names=["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])

        for b in batches:
            kind = b.schema.field("conv_id").type
            for c, codes, edits, cost, roles, texts, initials in zip(*(b.column(x).to_pylist() for x in ("conv_id", "codes", "edits", "cost", "roles", "texts", "initials")), strict=True):
                if own and own["conv"] != c:
                    yield settle()
                    own = {}
                own = own or {"conv": c, "n": np.zeros(4, np.int64), "illegal": 0, "cost": 0, "audit": [], "hash": hashlib.sha256(), "last": None, "lines": 0}
                own["n"] += np.bincount(np.frombuffer(codes, np.uint8) % 4, minlength=4)
                line = initials if own["last"] is None else [own["last"], *initials]
                own["illegal"] += sum(a + z not in ("su", "ua", "au") for a, z in zip(line, line[1:], strict=False))
                own["last"] = initials[-1]
                own["cost"] += cost
                own["audit"].append(edits)
                for r, t in zip(roles, texts, strict=True):
                    own["hash"].update(f"{chr(10) if own['lines'] else ''}{r}:{t}".encode())
                    own["lines"] += 1
        if own:
            yield settle()

    dealt = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "g")
    return dealt.mapInArrow(run, f"conv_id {conv}, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage: by crc32 of conv_id:turn rows go, lose their text or its stops, come twice or get the role user."""
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(own("conv_id"), F.lit(":"), own("turn")).cast("binary")) % 20
    x = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), own("role").alias("role"), own("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    return x.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), times)).alias("_copy")).drop("_copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the repair of all conversations after damage."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = damaged(given)
    found = summary(repair(turns)).withColumnRenamed("conv_id", "c")
    gaps = turns.groupBy(F.col("conv_id").alias("d")).agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    x = given.select("conv_id").distinct()
    x = x.join(found, x["conv_id"].eqNullSafe(found["c"]), "left")
    x = x.join(gaps, x["conv_id"].eqNullSafe(gaps["d"]), "left")
    return x.select(
        "conv_id",
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
