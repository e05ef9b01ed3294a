"""Structure repair of conversations by a grammar-compressed dynamic program.

A row of a conversation becomes one symbol: its role (user, assistant, system, other) and whether it ends in the middle of
a sentence, or that it must go. Re-Pair replaces the commonest pairs of neighbouring symbols of all conversations by new
symbols, round by round; the pairs are counted by Spark over the different sequences. For every symbol there is one
min-plus matrix: from a state (nothing yet, after system, after user, after assistant) to a state, the least cost and the
edits of that cost as a rope. A rule's matrix is the product of its two sides, worked out once, bottom-up, and shared by
all conversations; a conversation is the product over the few symbols that are left of it.

Of equal costs the edits least by ASCII win. That is kept by products: cost follows from the edits, so that edits of one
cost between the same states are never the beginning of one another, and what follows cannot turn their order round.

A long conversation is cut into stretches of ``STRETCH`` symbols, whose matrices are folded in order. Its texts are
streamed in order past its edits, never gathered: one task holds one character per row of a conversation, and the texts
of one batch. That stream is in one task for each conversation, since its digest is one pass over it.

Defined cases: a null role or text is one space (such a text is blank); null turns come first; a null id is a conversation
like any other; rows of the same turn stand by role, then text; repeated rows are duplicates. A role is told by its first
letter; an empty one has none and fits nowhere. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeline.llm.common import bound_batches, pin

RETOLD, DELETED, INSERTED, CUT_OFF = 3, 4, 3, 3
#: Symbols of a stretch; rules and rounds at most (more only save time); different stretches remembered in a task.
STRETCH, RULES, ROUNDS, KEPT = 4096, 256, 10, 20_000
#: States: nothing yet, after system, after user, after assistant. A repaired conversation ends in the first or last.
NONE, SYSTEM, USER, ASSISTANT = STATES = range(4)
ENDS = (NONE, ASSISTANT)
GONE = "x"
FIRST_RULE = 0xE000
NOT_BLANK = r"[^\x20\x09-\x0D]"


class Rope:
    """A text in parts, with a digest, so that long texts that share parts are compared by their parts."""

    __slots__ = ("text", "left", "right", "size", "digest")
    BASE, MOD, SHORT = 1_000_003, (1 << 61) - 1, 48

    def __init__(self, text: str | None, left: Rope | None = None, right: Rope | None = None) -> None:
        self.text, self.left, self.right = text, left, right
        if text is not None:
            self.size, self.digest = len(text), 0
            for c in text:
                self.digest = (self.digest * self.BASE + ord(c)) % self.MOD
        else:
            self.size = left.size + right.size
            self.digest = (left.digest * pow(self.BASE, right.size, self.MOD) + right.digest) % self.MOD

    def __add__(self, other: Rope) -> Rope:
        if not self.size or not other.size:
            return other if not self.size else self
        if self.text is not None and other.text is not None and self.size + other.size <= self.SHORT:
            return Rope(self.text + other.text)
        return Rope(None, self, other)

    def __lt__(self, other: Rope) -> bool:
        mine, its = [self], [other]
        while mine and its:
            x, y = mine.pop(), its.pop()
            if x.size == y.size and x.digest == y.digest:
                continue
            if x.text is not None and y.text is not None:
                n = min(x.size, y.size)
                if x.text[:n] != y.text[:n]:
                    return x.text < y.text
                if x.size > n:
                    mine.append(Rope(x.text[n:]))
                if y.size > n:
                    its.append(Rope(y.text[n:]))
            elif y.text is not None or (x.text is None and x.size >= y.size):
                mine += (x.right, x.left)
                its.append(y)
            else:
                its += (y.right, y.left)
                mine.append(x)
        return bool(its) and not mine

    def __str__(self) -> str:
        out, rest = [], [self]
        while rest:
            x = rest.pop()
            if x.text is not None:
                out.append(x.text)
            else:
                rest += (x.right, x.left)
        return "".join(out)


#: From a state to a state: (cost, edits). A state that cannot be reached is absent.
Row = dict[int, tuple[int, Rope]]


def keep_least(row: Row, state: int, cost: int, edits: Rope) -> None:
    old = row.get(state)
    if old is None or cost < old[0] or (cost == old[0] and edits < old[1]):
        row[state] = (cost, edits)


def times(row: Row, matrix: list[Row]) -> Row:
    """Min-plus product of one row with a matrix."""
    out: Row = {}
    for mid, (cost, edits) in row.items():
        for state, (more, then) in matrix[mid].items():
            old = out.get(state)
            if old is None or cost + more <= old[0]:
                keep_least(out, state, cost + more, edits + then)
    return out


def product(a: list[Row], b: list[Row]) -> list[Row]:
    return [times(row, b) for row in a]


def after(state: int) -> int:
    """State behind an inserted or retold row."""
    return ASSISTANT if state == USER else USER


def inserts() -> list[Row]:
    """Any number of inserted rows; more than two never pay."""
    out = []
    for state in STATES:
        row: Row = {state: (0, Rope(""))}
        one = after(state)
        keep_least(row, one, INSERTED, Rope("I"))
        keep_least(row, after(one), 2 * INSERTED, Rope("II"))
        out.append(row)
    return out


def terminal(symbol: str) -> list[Row]:
    """Matrix of one row: inserts ahead of it, then what is done with it."""
    steps = []
    for state in STATES:
        row: Row = {state: (DELETED, Rope("D"))}
        if symbol != GONE:
            more = CUT_OFF if symbol.isupper() else 0
            role = symbol.lower()
            fits = role == "u" and state != USER or role == "a" and state == USER or role == "s" and state == NONE
            if fits:
                keep_least(row, SYSTEM if role == "s" else after(state), more, Rope("K"))
            keep_least(row, after(state), RETOLD + more, Rope("R"))
        steps.append(row)
    return product(inserts(), steps)


TERMINALS = "uasoUASO" + GONE


class Grammar:
    """Rules of Re-Pair in order, and the matrix of every symbol."""

    def __init__(self, rules: list[str]) -> None:
        self.rules = [(pair, chr(FIRST_RULE + n)) for n, pair in enumerate(rules)]
        self.matrices = {s: terminal(s) for s in TERMINALS}
        for pair, name in self.rules:
            self.matrices[name] = product(self.matrices[pair[0]], self.matrices[pair[1]])

    def shorten(self, sequence: str) -> str:
        for pair, name in self.rules:
            sequence = sequence.replace(pair, name)
        return sequence

    def matrix(self, sequence: str, first: bool) -> list[Row]:
        """Matrix of a sequence; of the first stretch of a conversation only the row of its only state."""
        out: list[Row] = [{s: (0, Rope(""))} if s == NONE or not first else {} for s in STATES]
        for symbol in self.shorten(sequence):
            out = product(out, self.matrices[symbol])
        return out


def learn(sequences: DataFrame, rules: int = RULES, rounds: int = ROUNDS) -> list[str]:
    """Pairs to replace, in order, from the column ``sequence``.

    Each round counts the neighbouring pairs of all sequences, as they are by then, and takes the commonest ones that
    share no symbol: replacing one of these changes no count of the others. Only the top of the counts comes to the driver.
    """
    each = pin(sequences.groupBy("sequence").agg(F.count("*").alias("n")))
    found: list[str] = []
    for _ in range(rounds):
        held = list(found)

        def count(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            pairs, grammar = Counter(), [(pair, chr(FIRST_RULE + n)) for n, pair in enumerate(held)]
            for batch in batches:
                for sequence, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for pair, name in grammar:
                        sequence = sequence.replace(pair, name)
                    for a, b in zip(sequence, sequence[1:], strict=False):
                        pairs[a + b] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(pairs), pa.string()), pa.array(list(pairs.values()), pa.int64())], names=["pair", "n"])

        top = each.mapInArrow(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).filter("n > 1").orderBy(F.desc("n"), "pair").limit(64)
        used: set[str] = set()
        before = len(found)
        for r in top.collect():
            if len(found) < rules and not used & set(r["pair"]):
                used |= set(r["pair"])
                found.append(r["pair"])
        if len(found) == before or len(found) >= rules:
            break
    return found


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults planted by a hash of id and turn: one row in four, five ways."""
    filled = rows.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    said = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    way = F.crc32(said.cast("binary")) % 20
    text = F.when(way == 1, "").when(way == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(way == 4, "user").otherwise(F.col("role"))
    out = filled.withColumn("way", way).filter("way <> 0").withColumn("text", text).withColumn("role", role)
    copies = F.when(F.col("way") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.withColumn("copy", F.explode(copies)).select("conv_id", "turn", "role", "text")


def initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def marked(rows: DataFrame) -> DataFrame:
    """Rows with their place (from 0), symbol, fault, whether their turn is new and whether they may not follow the row ahead."""
    rows = rows.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    rows = rows.withColumn("said", F.sha2("text", 256))
    order = [F.asc_nulls_first("turn"), F.col("role"), F.col("text")]
    whole = Window.partitionBy("conv_id").orderBy(*order)
    same = Window.partitionBy("conv_id", "role", "said").orderBy(F.asc_nulls_first("turn"))
    last = F.regexp_extract("text", rf"({NOT_BLANK})[\x20\x09-\x0D]*\z", 1)
    ahead, turn_ahead = F.lag(initial("role")).over(whole), F.lag("turn").over(whole)
    rows = rows.withColumn("place", F.row_number().over(whole) - 1)
    rows = rows.withColumn("illegal", ahead.isNotNull() & ~F.concat(ahead, initial("role")).isin("su", "ua", "au"))
    rows = rows.withColumn("fresh", F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(turn_ahead))
    rows = rows.withColumn("again", F.row_number().over(same) > 1)
    fault = F.when(last == "", "blank").when(F.col("again"), "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    role = F.when(initial("role").isin("u", "a", "s"), initial("role")).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", F.upper(role)).otherwise(role)
    rows = rows.withColumn("fault", fault).withColumn("symbol", symbol)
    return rows.select("conv_id", "turn", "role", "text", F.col("place").cast("long").alias("place"), "symbol", "fault", "fresh", "illegal")


def audits(rows: DataFrame, stretch: int = STRETCH, rules: int = RULES) -> DataFrame:
    """``conv_id, cost, audit`` of every conversation of marked rows, all its rows being in the order of ``place``."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    number = F.expr(f"place div {int(stretch)}").alias("stretch")
    one = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "symbol"))), lambda x: x["symbol"]), "")
    stretches = pin(rows.groupBy("conv_id", number).agg(one.alias("sequence")))
    pairs = learn(stretches.select("sequence"), rules)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, known = Grammar(pairs), {}
        for batch in batches:
            costs, edits = [], []
            for number, sequence in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                key = (sequence, number == 0)
                if key not in known:
                    if len(known) >= KEPT:
                        known.clear()
                    told = [row.get(s) for row in grammar.matrix(*key) for s in STATES]
                    known[key] = [t and t[0] for t in told], [t and str(t[1]) for t in told]
                costs.append(known[key][0])
                edits.append(known[key][1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(costs, pa.list_(pa.int64())), pa.array(edits, pa.list_(pa.string()))], names=["conv_id", "stretch", "costs", "edits"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        closing = inserts()
        state: Row = {}
        now: list = []  # the id of the conversation being folded

        def done() -> tuple:
            cost, edits = None, None
            for s, (c, e) in sorted(times(state, closing).items()):
                if s in ENDS and (cost is None or c < cost or c == cost and e < edits):
                    cost, edits = c, e
            return now[0], cost, str(edits)

        for batch in batches:
            out = []
            for conv, number, costs, edits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number == 0:
                    if now:
                        out.append(done())
                    now, state = [conv], {NONE: (0, Rope(""))}
                matrix = [{s: (costs[4 * r + s], Rope(edits[4 * r + s])) for s in STATES if costs[4 * r + s] is not None} for r in STATES]
                state = times(state, matrix)
            yield from told(out)
        if now:
            yield from told([done()])

    def told(out: list[tuple]) -> Iterator[pa.RecordBatch]:
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], arrow), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out])], names=["conv_id", "cost", "audit"])

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(rows.schema["conv_id"].dataType)
    each = stretches.mapInArrow(matrices, f"conv_id {kind}, stretch long, costs array<long>, edits array<string>")
    in_order = each.repartition("conv_id").sortWithinPartitions("conv_id", "stretch")
    return in_order.mapInArrow(fold, f"conv_id {kind}, cost long, audit string")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``conv_id, edit, role, text``: the rows of every repaired conversation, from marked rows and their audits.

    A conversation's rows stand together in one part, in order. Its edits come first in the stream, then its rows.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    heads = found.select("conv_id", F.lit(-1).cast("long").alias("place"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = bound_batches(rows).select("conv_id", "place", "role", "text").unionByName(heads)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edits, at, conv, spoken = "", 0, None, ""
        for batch in batches:
            out: list[tuple] = []

            def insert(out=out) -> None:
                nonlocal at, spoken
                while at < len(edits) and edits[at] == "I":
                    spoken = "assistant" if spoken[:1] == "u" else "user"
                    out.append((conv, "I", spoken, ""))
                    at += 1

            for now, place, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                insert()  # also those left behind a conversation's last row
                if place < 0:
                    edits, at, conv, spoken = text, 0, now, ""
                    continue
                edit, at = edits[at], at + 1
                if edit != "D":
                    spoken = role if edit == "K" else "assistant" if spoken[:1] == "u" else "user"
                    out.append((conv, edit, spoken, text))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], batch.schema[0].type), *[pa.array([r[k] for r in out], pa.string()) for k in (1, 2, 3)]], names=["conv_id", "edit", "role", "text"])
        left = []
        while at < len(edits):
            spoken = "assistant" if spoken[:1] == "u" else "user"
            left.append((conv, "I", spoken, ""))
            at += 1
        if left:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in left], batch.schema[0].type), *[pa.array([r[k] for r in left], pa.string()) for k in (1, 2, 3)]], names=["conv_id", "edit", "role", "text"])

    in_order = both.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return in_order.mapInArrow(body, f"conv_id {kind}, edit string, role string, text string")


def digests(turns: DataFrame) -> DataFrame:
    """``conv_id, sha256`` of ``role:text`` lines, for rows that stand together by conversation as ``repaired`` leaves them."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list = []
        digest = None
        for batch in batches:
            out = []
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != [conv]:
                    if now:
                        out.append((now[0], digest.hexdigest()))
                    now, digest = [conv], hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], batch.schema[0].type), pa.array([r[1] for r in out], pa.string())], names=["conv_id", "sha256"])
        if now:
            yield pa.RecordBatch.from_arrays([pa.array(now, batch.schema[0].type), pa.array([digest.hexdigest()])], names=["conv_id", "sha256"])

    return turns.select("conv_id", "role", "text").mapInArrow(body, f"conv_id {kind}, sha256 string")


def report(original: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for every id of ``original``: what was wrong with its conversation in ``rows``, and what repairing it takes."""
    table = pin(marked(rows))
    found = pin(audits(table))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    faults = table.groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.sum(F.col("fresh").cast("long"))).alias("gaps"),
        *[count(F.col("fault") == f)(f) for f in ("blank", "duplicate", "truncated")],
        count(F.col("illegal"))("illegal"),
    )
    sums = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    parts = [original.select("conv_id").distinct(), faults, found, digests(repaired(table, found))]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    got = whole.groupBy("conv_id").agg(*[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in sums], F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("sha256"), F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))
    return got
