"""Conversation repair: cheapest edits that give a conversation the grammar (s?(ua)+)?, by a forward Viterbi pass.

The rows of all conversations are put in order by one range shuffle, so that a long conversation lies over several
partitions. Blocks of BLOCK rows are cut at conversations into pieces. A piece's pass carries, from each of the four grammar
states to each, the least (cost, audit): each row's layer of states is closed by at most two inserts. The pieces of a
conversation are then combined in order, which gives its audit and the states between its pieces, and every piece repairs
its own rows. Least (cost, audit) pairs combine exactly: audits of equal cost over the same rows are never prefixes of one
another, as letters fix the path, and a longer one would have cost more.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queuelens.llm.common import cut, table

#: Rows of a block: most rows of a piece. A power of two.
BLOCK = 1 << 12
#: Grammar states: nothing yet, after the system's turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
KEEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The only user's or assistant's turn that may follow each state.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
ENDS = (START, ASSISTANT)
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
FAULTS = ("blank", "duplicate", "truncated")
SPACE = r"\x20\x09-\x0D"

Layer = list[tuple[int, str] | None]


def closed(layer: Layer) -> Layer:
    """The layer with inserts: two of them in a row lead from any state to any that inserts can reach."""
    for _ in range(2):
        for s in range(4):
            if layer[s] is not None:
                new = (layer[s][0] + INSERT, layer[s][1] + "I")
                if layer[NEXT[s]] is None or new < layer[NEXT[s]]:
                    layer[NEXT[s]] = new
    return layer


def stepped(layer: Layer, initial: str, fault: int) -> Layer:
    """The layer after a row with a role's initial and a fault: 0 none, else its place in FAULTS from 1."""
    out: Layer = [None] * 4

    def put(t: int, cost: int, audit: str) -> None:
        if out[t] is None or (cost, audit) < out[t]:
            out[t] = (cost, audit)

    for s, held in enumerate(layer):
        if held is None:
            continue
        cost, audit = held
        put(s, cost + DELETE, audit + "D")
        if fault in (0, 3):
            cost += TRUNCATED * (fault == 3)
            if (s, initial) in KEEPS:
                put(KEEPS[s, initial], cost, audit + "K")
            put(NEXT[s], cost + REROLE, audit + "R")
    return closed(out)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that crc32 of conv_id:turn picks; nulls count as one space."""
    conv, turn, role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text"))
    code = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.when(code == 0, 0).when(code == 3, 2).otherwise(1)
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(code == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), copies)).alias("copy"))
    return rows.drop("copy")


def in_order(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with ``pos``, which ascends by conversation and turn, nulls first, then by role and
    text; written once. Rows that are equal throughout are interchangeable."""
    keys = ["conv_id", "turn", "role", "text"]
    ordered = rows.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
    return cut(ordered.withColumn("pos", F.monotonically_increasing_id()))


def _block(pos: str = "pos"):
    return F.shiftright(pos, BLOCK.bit_length() - 1)


def _rows(batches: Iterator[pa.RecordBatch], step: int = 256) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, len(batch), step):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, step).columns), strict=True)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)] if rows else [pa.array([], t) for t in schema.types], schema=schema)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


#: A piece: its first row, rows by fault, illegal neighbours inside, the initials and turns at its ends, distinct turns,
#: and the least cost (-1: none) and audit from each state to each.
_PIECE = "pos long, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, costs array<long>, audits array<string>"
_PIECE_ARROW = [("pos", pa.int64()), *((c, pa.int64()) for c in (*FAULTS, "illegal")), ("first", pa.string()), ("last", pa.string()), *((c, pa.int64()) for c in ("low", "high", "turns")), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]
LEGAL = ("su", "ua", "au")


def _pieces_of(conv: pa.DataType):
    schema = pa.schema([("conv_id", conv), *_PIECE_ARROW])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, first_at = None, None

        def row() -> tuple:
            flat = [x for start in layers for x in start]
            return (now[1], at, *faults, illegal, first, last, low, high, turns, [-1 if x is None else x[0] for x in flat], ["" if x is None else x[1] for x in flat])

        for block, pos, mark, conv_id, initial, blank, cut_off, turn in _rows(batches):
            if mark == 0:  # the row at this position is the first of its role and text
                first_at = pos
                continue
            if now != (block, conv_id):
                if now:
                    yield row()
                now, at, faults, illegal, first, last = (block, conv_id), pos, [0, 0, 0], 0, initial, None
                low = high = None
                turns, layers = 0, [[(0, "") if t == s else None for t in range(4)] for s in range(4)]
            fault = 1 if blank else 2 if first_at != pos else 3 if cut_off else 0
            if fault:
                faults[fault - 1] += 1
            illegal += last is not None and last + initial not in LEGAL
            if turn is not None:
                turns += turn != high
                low, high = turn if low is None else low, turn
            last = initial
            layers = [stepped(start, initial, fault) for start in layers]
        if now:
            yield row()

    return lambda batches: _batches(pieces(batches), schema, 16)


_PATH = "lead string, pos long, state int, to int, blank long, duplicate long, truncated long, illegal long, gaps long, cost long, audit string"
_PATH_ARROW = [("lead", pa.string()), ("pos", pa.int64()), ("state", pa.int32()), ("to", pa.int32()), *((c, pa.int64()) for c in (*FAULTS, "illegal", "gaps", "cost")), ("audit", pa.string())]


def _paths_of(conv: pa.DataType):
    """For each conversation: a row for each of its pieces, with the states between which it is repaired, and a last row
    with the sums, without a position. Only what the four best audits don't share, and back-pointers, are kept of each."""
    schema = pa.schema([("conv_id", conv), *_PATH_ARROW])

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now: tuple | None = None

        def rows() -> Iterator[tuple]:
            (cost, audit), state = min((layer[s], s) for s in ENDS if layer[s] is not None)
            gaps = 0 if low is None else min(high - low + 1 - turns, 2**63 - 1)
            yield (now[0], None, None, None, None, *sums, gaps, cost, "".join(shared) + audit)
            for n in range(len(back) - 1, -1, -1):
                pos, before = back[n]
                lead = "" if n else {START: "", USER: "I", ASSISTANT: "II"}[before[state]]
                yield (now[0], lead, pos, before[state], state, *[None] * 7)
                state = before[state]

        for conv_id, pos, *counts, first, last, p_low, p_high, p_turns, costs, audits in _rows(batches, 16):
            if now != (conv_id,):
                if now:
                    yield from rows()
                now, sums, low, high, turns, end, shared, back = (conv_id,), [0] * 4, None, None, 0, None, [], []
                layer = closed([(0, ""), None, None, None])
            sums = [a + b for a, b in zip(sums, counts, strict=True)]
            sums[3] += end is not None and end + first not in LEGAL
            if p_low is not None:
                turns += p_turns - (p_low == high)
                low, high = p_low if low is None else low, p_high
            end = last
            new: Layer = [None] * 4
            before = [0] * 4
            for s, held in enumerate(layer):
                for t in range(4):
                    if held is not None and costs[4 * s + t] >= 0:
                        x = (held[0] + costs[4 * s + t], held[1] + audits[4 * s + t])
                        if new[t] is None or x < new[t]:
                            new[t], before[t] = x, s
            same = os.path.commonprefix([x[1] for x in new if x is not None])
            shared.append(same)
            layer = [None if x is None else (x[0], x[1][len(same) :]) for x in new]
            back.append((pos, before))
        if now:
            yield from rows()

    return lambda batches: _batches(paths(batches), schema, 256)


def _mended_of(conv: pa.DataType):
    schema = pa.schema([("conv_id", conv), ("pos", pa.int64()), ("nth", pa.int32()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def mended(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        state, audit, at, last, nth = START, "", 0, None, 0
        for pos, mark, conv_id, role, text, lead, start, slice_ in _rows(batches):
            if pos != last:
                last, nth = pos, 0
            if mark == 0:  # a piece begins
                state, audit, at = START if lead else start, lead + slice_, 0
            else:
                edit, at = audit[at], at + 1
                if edit != "D":
                    state = KEEPS[state, role[:1]] if edit == "K" else NEXT[state]
                    yield conv_id, pos, nth, edit, role if edit == "K" else ROLE[state], text
                    nth += 1
            while at < len(audit) and audit[at] == "I":
                state, at = NEXT[state], at + 1
                yield conv_id, pos, nth, "I", ROLE[state], ""
                nth += 1

    return lambda batches: _batches(mended(batches), schema, 256)


def _arrow_type(df: DataFrame, column: str) -> tuple[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[column].dataType
    return kind.simpleString(), to_arrow_type(kind)


def repair(ordered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of in_order() rows: the repaired messages (conv_id, pos, nth, edit, role, text), to be read by pos and nth, and the
    report (conv_id, blank, duplicate, truncated, illegal, gaps, cost, audit).

    A row's first fault counts: blank, duplicate (role and text of an earlier row), truncated (its last character that is
    no space isn't . ! or ?). Keep costs 0, Rerole 1, Delete 2, Insert 5, an undeleted truncated row 5 more; blank rows
    and duplicates are deleted. Of edits of equal cost the ASCII-least audit is taken.

    No task takes more than a piece of a conversation's rows at once. The combining pass keeps the audit, which is one
    value of the report, and four numbers a piece.
    """
    kind, arrow = _arrow_type(ordered, "conv_id")
    end = F.regexp_extract("text", f"([^{SPACE}])[{SPACE}]*\\z", 1)
    key = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    codes = ordered.select(_block().alias("block"), "pos", F.lit(1).alias("mark"), "conv_id", F.substring("role", 1, 1).alias("initial"), (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("cut_off"), "turn")
    seen = ordered.where(end != "").groupBy("conv_id", key.alias("key")).agg(F.min("pos").alias("pos"))
    firsts = seen.select(_block().alias("block"), "pos", F.lit(0).alias("mark"))
    marked = codes.unionByName(firsts, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "pos", "mark")
    pieces = cut(marked.mapInArrow(_pieces_of(arrow), f"conv_id {kind}, {_PIECE}"))
    paths = cut(pieces.repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(_paths_of(arrow), f"conv_id {kind}, {_PATH}"))
    chosen = pieces.select("pos", "audits").join(paths.where(F.col("pos").isNotNull()).select("conv_id", "pos", "lead", "state", "to"), "pos")
    chosen = chosen.select("pos", F.lit(0).alias("mark"), "conv_id", "lead", "state", F.element_at("audits", 4 * F.col("state") + F.col("to") + 1).alias("audit"))
    rows = ordered.select("pos", F.lit(1).alias("mark"), "conv_id", "role", "text").unionByName(chosen, allowMissingColumns=True)
    mended = rows.repartition(_block()).sortWithinPartitions("pos", "mark").mapInArrow(_mended_of(arrow), f"conv_id {kind}, pos long, nth int, edit string, role string, text string")
    return mended, paths.where(F.col("pos").isNull()).select("conv_id", *FAULTS, "illegal", "gaps", "cost", "audit")


def _hashed_of(conv: pa.DataType):
    schema = pa.schema([("conv_id", conv), ("repaired_sha256", pa.string())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now: tuple | None = None
        for conv_id, role, text in _rows(batches):
            if now != (conv_id,):
                if now:
                    yield now[0], digest.hexdigest()
                now, digest = (conv_id,), hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        if now:
            yield now[0], digest.hexdigest()

    return lambda batches: _batches(hashed(batches), schema, 256)


def digests(mended: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of repair()'s messages. A hash of a whole conversation is taken in its order: its
    messages stream through one task, which keeps 64 bytes of state and never the conversation."""
    kind, arrow = _arrow_type(mended, "conv_id")
    rows = mended.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "nth").select("conv_id", "role", "text")
    return rows.mapInArrow(_hashed_of(arrow), f"conv_id {kind}, repaired_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each conv_id of ``conversations``, a null one included, damaged and then repaired.

    Null roles, texts and turns count as one space for the damage, null roles and texts as that text from then on (a blank
    text; a role that has to be changed or deleted). Null turns come first and don't count in gaps; rows of one turn go by
    role and text. Empty roles have no initial. Long texts are read whole. Equal rows are duplicates. An empty table gives
    no rows. Other columns are not read. A conversation may hold any share of the rows; only its audit and the stream of
    its hash are one task's.
    """
    conversations = table(spark, sf_dir, "conversations")
    mended, report = repair(in_order(damaged(conversations)))
    out = conversations.select("conv_id").distinct().join(report.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left")
    out = out.join(digests(mended).withColumnRenamed("conv_id", "e"), F.col("conv_id").eqNullSafe(F.col("e")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", *FAULTS, "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


SQL = r"""
with recursive crc as (
  select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) order by i) as t
  from (select unnest(range(256)) as i)),
coded as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda x: cast(ord(x) as bigint))),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 as code
  from conversations, crc),
rows as (
  select conv_id, turn, case when code = 4 then 'user' else role end as role,
    case code when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from coded, (select unnest([1, 2]) as copy) where code <> 0 and copy <= case when code = 3 then 2 else 1 end),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as nth,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) as tail, role[1] as initial
  from rows),
faults as (
  select *, case when tail = '' then 1 when nth > min(nth) over (partition by conv_id, role, text) then 2 when tail not in ('.', '!', '?') then 3 else 0 end as fault,
    lag(initial) over (partition by conv_id order by nth) as before
  from placed),
report as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate,
    count(*) filter (fault = 3) as truncated, count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal
  from faults group by conv_id),
layers as (
  select conv_id, 0 as nth, {c: 0, a: '', r: ''} as s0, cast(null as struct(c integer, a varchar, r varchar)) as s1,
    {c: 5, a: 'I', r: chr(10) || 'user:'} as s2, {c: 10, a: 'II', r: chr(10) || 'user:' || chr(10) || 'assistant:'} as s3
  from (select distinct conv_id from rows)
  union all
  select conv_id, nth, n0, n1, m2, list_min(list_filter([n3, {c: m2.c + 5, a: m2.a || 'I', r: m2.r || chr(10) || 'assistant:'}], lambda x: x.c is not null)) as m3
  from (
    select conv_id, nth, n0, n1, n3,
      list_min(list_filter(list_concat([n2], list_transform([n0, n1, n3], lambda s: {c: s.c + 5, a: s.a || 'I', r: s.r || chr(10) || 'user:'})), lambda x: x.c is not null)) as m2
    from (
      select conv_id, nth,
        {c: s0.c + 2, a: s0.a || 'D', r: s0.r} as n0,
        list_min(list_filter([{c: s1.c + 2, a: s1.a || 'D', r: s1.r}, {c: case when stays and initial = 's' then s0.c + more end, a: s0.a || 'K', r: s0.r || line}], lambda x: x.c is not null)) as n1,
        list_min(list_filter(list_concat([{c: s2.c + 2, a: s2.a || 'D', r: s2.r}],
          list_transform([s0, s1, s3], lambda s: {c: case when stays and initial = 'u' then s.c + more end, a: s.a || 'K', r: s.r || line}),
          list_transform([s0, s1, s3], lambda s: {c: case when stays then s.c + more + 1 end, a: s.a || 'R', r: s.r || chr(10) || 'user:' || text})), lambda x: x.c is not null)) as n2,
        list_min(list_filter([{c: s3.c + 2, a: s3.a || 'D', r: s3.r}, {c: case when stays and initial = 'a' then s2.c + more end, a: s2.a || 'K', r: s2.r || line},
          {c: case when stays then s2.c + more + 1 end, a: s2.a || 'R', r: s2.r || chr(10) || 'assistant:' || text}], lambda x: x.c is not null)) as n3
      from (
        select l.conv_id, f.nth, s0, s1, s2, s3, text, initial, fault in (0, 3) as stays, case when fault = 3 then 5 else 0 end as more, chr(10) || role || ':' || text as line
        from layers l join faults f on l.conv_id is not distinct from f.conv_id and f.nth = l.nth + 1)))),
ends as (
  select conv_id, list_min(list_filter([s0, s3], lambda x: x.c is not null)) as best from layers
  qualify row_number() over (partition by conv_id order by nth desc) = 1)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, cast(coalesce(best.c, 0) as bigint) as cost, coalesce(best.a, '') as audit, sha256(coalesce(best.r[2:], '')) as repaired_sha256
from (select distinct conv_id from conversations) o
left join report p on o.conv_id is not distinct from p.conv_id left join ends e on o.conv_id is not distinct from e.conv_id
"""
