"""Repair of conversations whose turns are blank, repeated, cut off or out of order.

A conversation is the rows of one conv_id by turn (NULL first; rows of one turn by role, then
text). A sound one has role initials `(s?(ua)+)?`. Edits: Keep costs 0, Rerole to user or
assistant 1, Delete 2 (the only one for blank and repeated rows), Insert of an empty user or
assistant row 5; a cut-off row that is not deleted adds 5. Of the cheapest repairs the one whose
edit initials are least in ASCII order is taken.

Viterbi with coalescing survivors. Four states say what the repaired rows end with. Every row takes each
state's survivor on; survivors are leaves of a tree of backpointers whose nodes count their references. Nodes that
lose their last reference go, and as soon as all survivors descend from one child of the
root, that child's edits are final and are emitted. Edits inserted between two rows
belong to the later row, so no survivor's edits are a prefix of another's and two survivors of equal
cost compare by their complete unresolved edits. Their order is kept with them: a new survivor
sorts by (order of the one it extends, edits added), which is the order of the complete edits,
so a tie costs no walk however long the unresolved part is. A survivor that another one can
replace for less, whatever follows, is dropped (`SPARE`); without that the state before any kept
row would hold every conversation open.

A conversation of at most `long_rows` rows is streamed by one task, which holds its unresolved
rows. Longer ones are cut into pieces by ranges of their order. A piece gives costs and order of its
best edits for every pair of states at its ends; one row per piece meets per conversation
and fixes the states between pieces, then all pieces emit their edits side by side.

Defined results: NULL role and text are one space (`plain`). A NULL conv_id is a conversation of its own. A role without a
known initial cannot be kept. Identical rows of one turn are repeats. Extra columns are not read.
An empty table gives no rows.
"""

import hashlib
from collections import deque

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from pulsemill.llm.batches import stored
from pulsemill.llm.sorted_groups import runs

LONG_ROWS = 50_000
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
BLANKS = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 60

# States that inserted rows lead to, with the edits and their cost.
INSERTS = {START: ((START, "", 0), (USER, "I", INSERT), (ASSISTANT, "II", 2 * INSERT)),
           SYSTEM: ((SYSTEM, "", 0), (USER, "I", INSERT), (ASSISTANT, "II", 2 * INSERT)),
           USER: ((USER, "", 0), (ASSISTANT, "I", INSERT)),
           ASSISTANT: ((ASSISTANT, "", 0), (USER, "I", INSERT))}
# Where each state may end, with the edits that close it.
CLOSING = {START: ("", 0), SYSTEM: ("II", 2 * INSERT), USER: ("I", INSERT), ASSISTANT: ("", 0)}
# SPARE[y][x]: whatever may follow state x may follow state y for at most so much more.
SPARE = {START: {SYSTEM: 0, USER: INSERT, ASSISTANT: 0},
         SYSTEM: {START: 2 * INSERT, USER: INSERT, ASSISTANT: 2 * INSERT},
         USER: {START: INSERT + DELETE, SYSTEM: INSERT, ASSISTANT: INSERT},
         ASSISTANT: {START: DELETE, SYSTEM: 0, USER: INSERT}}


def _moves(initial, fault):
    """((to, ((from, edits, cost), ...)), ...) for a row of this role initial and fault."""
    best = {}
    extra = CUT_OFF if fault == "truncated" else 0
    for q in INSERTS:
        for mid, word, cost in INSERTS[q]:
            ways = [(mid, "D", DELETE)]
            if fault not in ("blank", "duplicate"):
                if mid != USER:
                    if initial == "s" and mid == START:
                        ways.append((SYSTEM, "K", KEEP + extra))
                    ways.append((USER, "K", KEEP + extra) if initial == "u" else (USER, "R", REROLE + extra))
                else:
                    ways.append((ASSISTANT, "K", KEEP + extra) if initial == "a"
                                else (ASSISTANT, "R", REROLE + extra))
            for to, edit, more in ways:
                best[to, q] = min(best.get((to, q), (FAR, "")), (cost + more, word + edit))
    return tuple((to, tuple((q, w, c) for (t, q), (c, w) in best.items() if t == to))
                 for to in sorted({t for t, _ in best}))


MOVES = {(i, f): _moves(i, f) for i in ("s", "u", "a", "") for f in ("", "blank", "duplicate", "truncated")}


class Node:
    __slots__ = ("parent", "word", "refs", "kids")

    def __init__(self, parent, word):
        self.parent, self.word, self.refs, self.kids = parent, word, 0, []


class Trellis:
    """Survivors {state: (cost, order, node)} over a tree of unresolved edits.

    With `held` False no tree is kept and only costs and orders are tracked."""

    def __init__(self, start=START, held=True):
        self.held = held
        self.root = Node(None, "") if held else None
        self.alive = {start: (0, 0, self.root)}
        if held:
            self.root.refs = 1

    def step(self, moves):
        """Take one row in; the edits (a word per row) that are now final."""
        alive, found = self.alive, {}
        for to, ways in moves:
            best = None
            for q, word, cost in ways:
                s = alive.get(q)
                if s is not None:
                    new = (s[0] + cost, s[1], word, q)
                    if best is None or new < best:
                        best = new
            if best is not None:
                found[to] = best
        for x in [x for x in found for y in found if y != x and found[x][0] > found[y][0] + SPARE[y][x]]:
            found.pop(x, None)
        self.alive = {}
        for order, (state, (cost, _, word, q)) in enumerate(sorted(found.items(), key=lambda f: f[1][1:3])):
            node = None
            if self.held:
                parent = alive[q][2]
                node = Node(parent, word)
                node.refs = 1
                parent.refs += 1
                parent.kids.append(node)
            self.alive[state] = (cost, order, node)
        if not self.held:
            return ()
        for _, _, node in alive.values():
            self._release(node)
        return self._resolved()

    def _release(self, node):
        node.refs -= 1
        while node.refs == 0 and node.parent is not None:
            up = node.parent
            up.kids.remove(node)
            up.refs -= 1
            node = up

    def _resolved(self):
        out = []
        while self.root.refs == 1 and self.root.kids:
            self.root = self.root.kids[0]
            self.root.parent = None
            out.append(self.root.word)
        return out

    def end(self, exit_state=None):
        """(cost, edits not yet emitted: a word per row, closing edits); closes the conversation, or
        ends at the given state."""
        if exit_state is None:
            cost, _, state = min((c + CLOSING[s][1], o, s) for s, (c, o, _) in self.alive.items())
            closing = CLOSING[state][0]
        else:
            state, closing = exit_state, ""
            cost = self.alive[state][0]
        out, node = [], self.alive[state][2]
        while node is not self.root:
            out.append(node.word)
            node = node.parent
        return cost, out[::-1], closing


class Reader:
    """Says what is wrong with each row and counts it, in the order of the conversation."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.first_initial = self.last_initial = None
        self.before, self.seen = None, set()

    def moves(self, turn, role, text, repeated=None):
        """The moves of a row. `repeated` says that an earlier turn has the same role and text; where it is
        None, all rows seen so far are looked through."""
        initial = role[:1]
        if self.last_initial is None:
            self.first_initial = initial
        elif self.last_initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last_initial = initial
        if turn is not None and (self.last_turn is None or turn != self.last_turn):
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        if repeated is None:
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            repeated = key in self.seen
            self.seen.add(key)
        elif (turn, role, text) == self.before:
            repeated = True
        self.before = (turn, role, text)
        bare = text.rstrip(BLANKS)
        fault = ""
        if not bare:
            self.blank += 1
            fault = "blank"
        elif repeated:
            self.duplicate += 1
            fault = "duplicate"
        elif bare[-1] not in ".!?":
            self.truncated += 1
            fault = "truncated"
        return MOVES[initial if initial in ("s", "u", "a") else "", fault]

    def gaps(self):
        if self.first_turn is None:
            return 0
        return min(self.last_turn - self.first_turn + 1 - self.turns, (1 << 63) - 1)


class Writer:
    """Applies final edits to the rows that wait for them: (edit, turn, role, text) each."""

    def __init__(self, state=START):
        self.state, self.waiting = state, deque()

    def add(self, turn, role, text):
        self.waiting.append((turn, role, text))

    def apply(self, word):
        for edit in word:
            if edit == "I":
                yield "I", None, self._next(), ""
                continue
            turn, role, text = self.waiting.popleft()
            if edit == "K":
                self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
            elif edit == "R":
                role = self._next()
            yield edit, turn, role, text

    def _next(self):
        self.state = ASSISTANT if self.state == USER else USER
        return "assistant" if self.state == ASSISTANT else "user"


class Digest:
    """The edits' initials and the hash of the repaired rows, from edits in order."""

    def __init__(self):
        self.audit, self.sum, self.any = [], hashlib.sha256(), False

    def add(self, edit, turn, role, text):
        self.audit.append(edit)
        if edit != "D":
            self.sum.update(("\n" * self.any + f"{role}:{text}").encode())
            self.any = True


def plain(rows: DataFrame) -> DataFrame:
    """The columns that are read, NULL role and text as one space, and whether a row is `present`
    (one that is not only says that its conversation exists)."""
    present = F.col("present") if "present" in rows.columns else F.lit(True)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"),
                       F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                       present.alias("present"), _key().alias("key"))


def _key():
    """A NULL conv_id and an empty one are different conversations."""
    return F.when(F.col("conv_id").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("conv_id").cast("string")))


ORDER = ["turn", "role", "text"]  # Spark sorts NULL first
STATS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _field(df, name):
    return StructField("conv_id", df.schema[name].dataType)


def _edits_schema(rows):
    return StructType([_field(rows, "conv_id"), StructField("piece", LongType()), StructField("no", LongType()),
                       StructField("edit", StringType()), StructField("turn", LongType()),
                       StructField("role", StringType()), StructField("text", StringType())])


def _digest_schema(rows):
    return StructType([_field(rows, "conv_id"), *[StructField(c, LongType()) for c in STATS],
                       StructField("audit", StringType()), StructField("repaired_sha256", StringType())])


def _batched(rows, schema, size=2000):
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)


def _columns(part, *names):
    return zip(*[part.column(n).to_pylist() for n in names])


def _short(rows: DataFrame, digests: bool) -> DataFrame:
    """Conversations that one task streams: their digests, or all their edits."""
    schema = _digest_schema(rows) if digests else _edits_schema(rows)
    arrow = to_arrow_schema(schema)

    def solve(batches):
        reader = None

        def emitted(words):
            nonlocal no
            for word in words:
                for e in writer.apply(word):
                    if digests:
                        digest.add(*e)
                    else:
                        yield (conv, 0, no, *e)
                    no += 1

        def closed():
            cost, words, closing = trellis.end()
            yield from emitted([*words, closing])
            if digests:
                yield (conv, reader.gaps(), reader.blank, reader.duplicate, reader.truncated, reader.illegal, cost,
                       "".join(digest.audit), digest.sum.hexdigest())

        for new, _, part in runs(batches, "key"):
            if new:
                if reader is not None:
                    yield from closed()
                conv = part.column("conv_id")[0].as_py()
                reader, trellis, writer, digest, no = Reader(), Trellis(), Writer(), Digest(), 0
            for turn, role, text, present in _columns(part, "turn", "role", "text", "present"):
                if present:
                    writer.add(turn, role, text)
                    yield from emitted(trellis.step(reader.moves(turn, role, text)))
        if reader is not None:
            yield from closed()

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.repartition(tasks, "key").sortWithinPartitions("key", *ORDER)
            .mapInArrow(lambda b: _batched(solve(b), arrow), schema))


PIECE = StructType([StructField("key", StringType()), StructField("piece", LongType()),
                    *[StructField(c, LongType()) for c in ("blank", "duplicate", "truncated", "illegal", "turns")],
                    *[StructField(c, StringType()) for c in ("first_turn", "last_turn", "first_initial",
                                                             "last_initial", "ways")]])
CHAIN = StructType([StructField("key", StringType()), StructField("piece", LongType()),
                    StructField("enter", LongType()), StructField("leave", LongType()),
                    *[StructField(c, LongType()) for c in STATS]])


def _pieces(rows: DataFrame) -> DataFrame:
    """Rows of long conversations with the number of their piece and of their row in it, and whether
    an earlier turn has the same row. Identical rows are never parted."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sum_of = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")
    tagged = rows.withColumn("sum", F.unhex(F.md5(sum_of)))
    repeats = tagged.groupBy("key", "sum").agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("there"), "turn")).alias("first"),
        F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = (F.col("first").isNotNull()
             & (F.struct(F.col("turn").isNotNull().alias("there"), "turn") > F.col("first")))
    tagged = (tagged.join(repeats, ["key", "sum"], "left").withColumn("repeated", later)
              .select("key", "conv_id", "turn", "role", "text", "repeated"))
    ranged = tagged.repartitionByRange(n, "key", "turn", "role", F.substring("text", 1, 64))
    ranged = ranged.sortWithinPartitions("key", *ORDER)
    # A task's number in the high bits, its rows' numbers in the low ones.
    numbered = ranged.withColumn("at", F.monotonically_increasing_id())
    return stored(numbered.withColumn("piece", F.shiftright("at", 33))
                  .withColumn("piece_key", F.concat_ws("/", "piece", "key")), "pieces")


def _by_piece(rows: DataFrame) -> DataFrame:
    return rows.repartition("piece_key").sortWithinPartitions("piece_key", "at")


def _chained(pieces: DataFrame) -> DataFrame:
    """(key, piece, enter, leave) and the whole conversation's numbers, one row per piece."""
    arrow = to_arrow_schema(PIECE)

    def summary(batches):
        reader = None

        def closed():
            text = ";".join(f"{s},{t},{c},{o}" for s, w in ways.items() for t, (c, o, _) in w.alive.items())
            yield (key, piece, reader.blank, reader.duplicate, reader.truncated, reader.illegal, reader.turns,
                   *[None if t is None else str(t) for t in (reader.first_turn, reader.last_turn)],
                   reader.first_initial, reader.last_initial, text)

        for new, _, part in runs(batches, "piece_key"):
            if new:
                if reader is not None:
                    yield from closed()
                key, piece = part.column("key")[0].as_py(), part.column("piece")[0].as_py()
                reader, ways = Reader(), {s: Trellis(s, held=False) for s in INSERTS}
            for turn, role, text, repeated in _columns(part, "turn", "role", "text", "repeated"):
                moves = reader.moves(turn, role, text, repeated)
                for t in ways.values():
                    t.step(moves)
        if reader is not None:
            yield from closed()

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("piece")
        trellis = Trellis()
        total, last_initial, last_turn, first_turn, turns = dict.fromkeys(STATS, 0), None, None, None, 0
        words = []
        for p in pdf.itertuples():
            moves = {}
            for way in p.ways.split(";"):
                s, t, c, o = map(int, way.split(","))
                # Orders of ways from one state compare with each other only, as a tie of survivors from
                # different states is settled by the survivors' own order.
                moves.setdefault(t, []).append((s, f"{o}{s}{t}", c))
            words += trellis.step(tuple((t, tuple(w)) for t, w in sorted(moves.items())))
            for c in ("blank", "duplicate", "truncated", "illegal"):
                total[c] += int(getattr(p, c))
            if last_initial is not None and last_initial + p.first_initial not in ("su", "ua", "au"):
                total["illegal"] += 1
            last_initial = p.last_initial
            if p.first_turn is not None:
                turns += int(p.turns) - (last_turn == int(p.first_turn))
                first_turn = int(p.first_turn) if first_turn is None else first_turn
                last_turn = int(p.last_turn)
        total["cost"], rest, _ = trellis.end()
        if first_turn is not None:
            total["gaps"] = min(last_turn - first_turn + 1 - turns, (1 << 63) - 1)
        rows = [(p.key, p.piece, int(w[-2]), int(w[-1]), *[total[c] for c in STATS])
                for p, w in zip(pdf.itertuples(), [*words, *rest])]
        return pd.DataFrame(rows, columns=[f.name for f in CHAIN])

    parts = _by_piece(pieces).mapInArrow(lambda b: _batched(summary(b), arrow), PIECE)
    return parts.groupBy("key").applyInPandas(chain, CHAIN)


def _long_edits(pieces: DataFrame, chained: DataFrame) -> DataFrame:
    schema = _edits_schema(pieces)
    arrow = to_arrow_schema(schema)
    last = chained.groupBy("key").agg(F.max("piece").alias("last_piece"))
    ends = chained.select("key", "piece", "enter", "leave").join(last, "key").select(
        F.concat_ws("/", "piece", "key").alias("piece_key"), "enter", "leave",
        (F.col("piece") == F.col("last_piece")).alias("closes"))

    def solve(batches):
        reader = None

        def emitted(words):
            nonlocal no
            for word in words:
                for e in writer.apply(word):
                    yield (conv, piece, no, *e)
                    no += 1

        def closed():
            _, words, _ = trellis.end(leave)
            yield from emitted([*words, CLOSING[leave][0] if closes else ""])

        for new, _, part in runs(batches, "piece_key"):
            if new:
                if reader is not None:
                    yield from closed()
                conv, piece, enter, leave, closes = next(_columns(
                    part.slice(0, 1), "conv_id", "piece", "enter", "leave", "closes"))
                reader, trellis, writer, no = Reader(), Trellis(enter), Writer(enter), 0
            for turn, role, text, repeated in _columns(part, "turn", "role", "text", "repeated"):
                writer.add(turn, role, text)
                yield from emitted(trellis.step(reader.moves(turn, role, text, repeated)))
        if reader is not None:
            yield from closed()

    both = pieces.join(ends, "piece_key")
    return _by_piece(both).mapInArrow(lambda b: _batched(solve(b), arrow), schema)


def _long_digests(edits: DataFrame, chained: DataFrame) -> DataFrame:
    """A hash goes over its conversation in order: one task streams its edits and holds their
    initials alone."""
    schema = StructType([StructField("key", StringType()), edits.schema["conv_id"],
                         StructField("audit", StringType()), StructField("repaired_sha256", StringType())])
    arrow = to_arrow_schema(schema)

    def hashed(batches):
        digest = None
        for new, now, part in runs(batches, "key"):
            if new:
                if digest is not None:
                    yield key, conv, "".join(digest.audit), digest.sum.hexdigest()
                key, conv, digest = now, part.column("conv_id")[0].as_py(), Digest()
            for e in _columns(part, "edit", "turn", "role", "text"):
                digest.add(*e)
        if digest is not None:
            yield key, conv, "".join(digest.audit), digest.sum.hexdigest()

    done = (edits.withColumn("key", _key()).repartition("key").sortWithinPartitions("key", "piece", "no")
            .mapInArrow(lambda b: _batched(hashed(b), arrow, 1), schema))
    totals = chained.select("key", *STATS).distinct()
    return done.join(totals, "key").select("conv_id", *STATS, "audit", "repaired_sha256")


def _parted(rows: DataFrame, long_rows: int):
    """(rows of short conversations, pieces of long ones or None)"""
    rows = plain(rows)
    long = rows.groupBy("key").count().where(F.col("count") > long_rows).select("key")
    if not long.limit(1).count():
        return rows, None
    return rows.join(long, "key", "left_anti"), _pieces(rows.join(long, "key", "left_semi").where("present"))


def repair(rows: DataFrame, long_rows: int = LONG_ROWS) -> DataFrame:
    """All edits, one row each: conv_id, (piece, no) in order, edit, turn, and role and text as they are after it.
    The rows without D are the repaired conversations."""
    short, pieces = _parted(rows, long_rows)
    out = _short(short, digests=False)
    if pieces is not None:
        out = out.unionByName(_long_edits(pieces, stored(_chained(pieces), "chain")))
    return out


def digest(rows: DataFrame, long_rows: int = LONG_ROWS) -> DataFrame:
    """One row per conversation: what was wrong, the cost, the edits' initials and the hash of the
    repaired rows (`role:text`, joined by newlines)."""
    short, pieces = _parted(rows, long_rows)
    out = _short(short, digests=True)
    if pieces is not None:
        chained = stored(_chained(pieces), "chain")
        out = out.unionByName(_long_digests(_long_edits(pieces, chained), chained))
    return out


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with planted faults, drawn by the checksum of `conv_id:turn`: one in twenty each is dropped (it
    stays as not `present`), emptied, robbed of sentence ends, repeated, or given to the user."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    drawn = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"),
                        (F.crc32(F.concat_ws(":", *named)) % 20).alias("draw"))
    return drawn.select(
        "conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("draw") == 0, F.array(F.lit(False)))
                  .when(F.col("draw") == 3, F.array(F.lit(True), F.lit(True)))
                  .otherwise(F.array(F.lit(True)))).alias("present"))
