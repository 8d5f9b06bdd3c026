"""Repair of conversation structure: the cheapest edits after which roles read ``(s?(ua)+)?``.

Faults are flags from windows over a conversation: blank, repeated and truncated turns, and pairs of roles that don't follow each
other. Then the turns are collected in order, and one fold carries four (cost, audit) structs: the cheapest edits that leave nothing,
a system turn, a user turn or an assistant turn as the last one. Keep costs 0, Rerole 3, Delete 4, Insert 3, an undeleted truncated
turn 3 more; ``least`` takes the cheapest, of equal ones the audit that is least in ASCII. Two equally cheap audits of the same turns
are never a beginning of one another, so the least one stays least whatever follows.

A conversation of more than ``LONG`` turns isn't collected. Its turns are range-partitioned in order and cut into blocks; each block
is folded from all four states, which gives a 4 x 4 table of (cost, audit), and the tables are folded in place of the turns. The
texts are rendered block by block, and the digest runs over the blocks as a stream. Both ways give the same rows. What is kept whole
of a long conversation is its audit, which the result holds.

Null conversations are one conversation; null roles and texts are a space, null turns come first and leave gaps alone. Turns of the
same number go by role, then by text. A conversation without turns has zeros, an empty audit and the digest of an empty string; a
role that is empty or of another kind can't be kept. Only the four columns are read, so other columns can't clash. An empty table
gives an empty result. Gaps beyond 64 bits are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import SPACES, small_batches, stored

#: Turns up to which a conversation is collected; turns of a block of a longer one.
LONG, BLOCK = 4096, 1024
#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: The state after a turn: nothing yet, system, user, assistant.
STATES = "esua"
#: Pairs of role initials that may follow each other.
PAIRS = ("su", "ua", "au")
#: The cost of what can't be reached.
NEVER = 1 << 40


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def damage(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, turn, role, text, copy, alive``: the turns after damage by a checksum of conversation and turn. A dropped turn stays as a row that isn't alive."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(filled(conv), F.lit(":"), filled(turn)).cast("binary")) % 20
    said = F.when(code == 1, "").when(code == 2, F.regexp_replace(filled(text), "[.!?]", "")).otherwise(filled(text))
    copies = F.sequence(F.lit(1), F.when(code == 3, 2).otherwise(1))
    return turns.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.when(code == 4, "user").otherwise(filled(role)).alias("role"),
        said.alias("text"), F.explode(copies).alias("copy"), (code != 0).alias("alive"),
    )


def _marks(role: Column, text: Column, repeated: Column) -> dict[str, Column]:
    """A turn's role initial and its first fault."""
    core = F.rtrim(text, F.lit(SPACES))
    fault = F.when(core == "", "blank").when(repeated, "duplicate").when(~F.substring(core, -1, 1).isin(".", "!", "?"), "truncated")
    return {"initial": F.substring(role, 1, 1), "fault": fault}


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("copy")]


# the fold


def _edits(cost: Column, audit: Column) -> Column:
    return F.struct(cost.alias("cost"), audit.alias("audit"))


def _more(edits: Column, cost: Column | int, letter: Column | str) -> Column:
    return _edits(edits["cost"] + cost, F.concat(edits["audit"], F.lit(letter) if isinstance(letter, str) else letter))


def _four(columns: dict[str, Column]) -> Column:
    return F.struct(*[columns[s].alias(s) for s in STATES])


def _begin(state: str) -> Column:
    """Nothing spent in one state, the others out of reach."""
    return _four({s: _edits(F.lit(0 if s == state else NEVER).cast("long"), F.lit("")) for s in STATES})


def _inserted(now: Column) -> Column:
    """With turns inserted here: at most a user turn and an assistant turn pay."""
    user = F.least(now["u"], *[_more(now[s], INSERT, "I") for s in "esa"])
    return _let(user, lambda u: _four({"e": now["e"], "s": now["s"], "u": u, "a": F.least(now["a"], _more(u, INSERT, "I"))}))


def _after(now: Column, turn: Column) -> Column:
    """The four structs after one more turn."""

    def edited(z: Column) -> Column:
        gone = {s: _more(z[s], DELETE, "D") for s in STATES}
        own = lambda s: turn["initial"] == s
        late = F.when(turn["fault"] == "truncated", TRUNCATED).otherwise(0)
        becomes = lambda before, s: _more(z[before], F.when(own(s), 0).otherwise(REROLE) + late, F.when(own(s), "K").otherwise("R"))
        stays = {
            "e": gone["e"], "s": F.when(own("s"), F.least(gone["s"], _more(z["e"], late, "K"))).otherwise(gone["s"]),
            "u": F.least(gone["u"], *[becomes(b, "u") for b in "esa"]), "a": F.least(gone["a"], becomes("u", "a")),
        }
        return F.when(turn["fault"].isin("blank", "duplicate"), _four(gone)).otherwise(_four(stays))

    return _let(_inserted(now), edited)


def fold(turns: Column, state: str = "e") -> Column:
    """The four (cost, audit) structs after ``turns`` (array of structs with initial and fault), begun in a state."""
    return F.aggregate(turns, _begin(state), _after)


def ended(now: Column) -> Column:
    """The cheapest edits that end with nothing or with an assistant turn."""
    return _let(_inserted(now), lambda z: F.least(z["e"], z["a"]))


def rendered(turns: Column, audit: Column, state: Column) -> Column:
    """The lines ``role:text`` that an audit makes of ``turns`` (structs with role, text and initial), begun in a state."""
    letters = lambda text: F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1)))
    some = lambda text, body: F.when(F.length(text) > 0, body).otherwise(F.array().cast("array<string>"))

    def lines(left: Column, made: Column) -> Column:
        system = (state == "e") & F.startswith(made, F.lit("K")) & (F.get(left, F.lit(0))["initial"] == "s")
        skip = F.when(system, 1).otherwise(0) + F.when(state == "u", 1).otherwise(0)

        def line(i: Column) -> Column:
            letter = F.substring(made, i, F.lit(1))
            role = F.when((i - 1 + skip) % 2 == 0, "user").otherwise("assistant")
            turn = F.get(left, F.length(F.replace(F.substring(made, F.lit(1), i), F.lit("I"), F.lit(""))) - 1)
            return F.when(letter == "I", F.concat(role, F.lit(":"))).otherwise(_let(turn, lambda t: F.concat(F.when(letter == "K", t["role"]).otherwise(role), F.lit(":"), t["text"])))

        return F.transform(F.sequence(F.lit(1), F.length(made)), line)

    own = F.replace(audit, F.lit("I"), F.lit(""))
    left = _let(some(own, letters(own)), lambda ops: F.filter(turns, lambda _, i: F.get(ops, i) != "D"))
    made = F.replace(audit, F.lit("D"), F.lit(""))
    return _let(F.struct(left.alias("left"), made.alias("made")), lambda x: some(x["made"], lines(x["left"], x["made"])))


# whole conversations


def _gaps(most: Column, least: Column, distinct: Column) -> Column:
    wide = "decimal(38,0)"
    return F.coalesce((most.cast(wide) - least.cast(wide) + 1 - distinct.cast(wide)).try_cast("long"), F.when(distinct == 0, 0)).cast("long")


def _count(faults: Column, kind: str) -> Column:
    return F.size(F.filter(faults, lambda f: f == kind)).cast("long")


def _collected(turns: DataFrame) -> DataFrame:
    """One row for each conversation of bounded length: one shuffle by conversation, then windows, the collected turns and their fold."""
    whole = Window.partitionBy("conv", "alive").orderBy(*_order())
    # by place, so that of equal rows the same one is the first in both windows
    same = Window.partitionBy("conv", "alive", "role", "text").orderBy("at")
    marked = turns.repartition("conv").withColumn("at", F.row_number().over(whole)).withColumn("nth", F.row_number().over(same))
    marked = marked.withColumns(_marks(F.col("role"), F.col("text"), F.col("nth") > 1))
    odd = ~F.concat(F.lag("initial").over(whole), F.col("initial")).isin(*PAIRS)
    turn = F.struct("at", "turn", "role", "text", "initial", "fault", F.coalesce(odd, F.lit(False)).alias("odd"))
    each = marked.withColumn("one", F.when(F.col("alive"), turn)).groupBy("conv").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    each = each.withColumn("best", ended(fold(F.col("turns")))).withColumn("lines", rendered(F.col("turns"), F.col("best.audit"), F.lit("e")))
    numbers, faults = F.filter("turns.turn", lambda t: t.isNotNull()), F.col("turns.fault")
    return each.select(
        "conv", _gaps(F.array_max(numbers), F.array_min(numbers), F.size(F.array_distinct(numbers))).alias("gaps"),
        *[_count(faults, k).alias(k) for k in ("blank", "duplicate", "truncated")], F.size(F.filter("turns.odd", lambda o: o)).cast("long").alias("illegal"),
        F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"), F.sha2(F.array_join("lines", "\n"), 256).alias("repaired_sha256"),
    )


# conversations in blocks


def _digests(blocks: DataFrame, kind: str) -> DataFrame:
    """``conv, repaired_sha256`` of ``conv, block, body``: a running digest over blocks in order, with one block in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, first = None, None, True
        row = lambda: pa.RecordBatch.from_arrays([now, pa.array([digest.hexdigest()])], ["conv", "repaired_sha256"])
        for batch in batches:
            for n in range(len(batch)):
                conv, body = batch.column("conv").slice(n, 1), batch.column("body")[n].as_py()
                if now is None or conv[0] != now[0] and not (conv.null_count and now.null_count):
                    if now is not None:
                        yield row()
                    now, digest, first = conv, hashlib.sha256(), True
                if body is not None:
                    digest.update(body.encode() if first else b"\n" + body.encode())
                    first = False
        if now is not None:
            yield row()

    small_batches(blocks.sparkSession)
    ordered = blocks.select("conv", "block", "body").repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "block")
    return ordered.mapInArrow(run, f"conv {kind}, repaired_sha256 STRING")


def _in_blocks(turns: DataFrame) -> DataFrame:
    """The same rows for conversations of any length."""
    kind = turns.schema["conv"].dataType.simpleString()
    key = [F.col("conv").asc_nulls_first(), *_order()]
    ordered = turns.where("alive").repartitionByRange(*key).sortWithinPartitions(*key).withColumn("at", F.monotonically_increasing_id())
    ordered = stored(ordered.withColumn("block", F.floor(F.col("at") / BLOCK).cast("long")), "long-turns")

    firsts = ordered.groupBy("conv", "role", F.sha2("text", 256).alias("digest")).agg(F.min("at").alias("first_at")).select("first_at")
    marked = ordered.join(firsts, F.col("at") == F.col("first_at"), "left").withColumns(_marks(F.col("role"), F.col("text"), F.col("first_at").isNull()))
    turn = F.struct("at", "initial", "fault")
    tables = F.array(*[fold(F.col("turns"), s) for s in STATES])
    initials = F.col("turns.initial")
    pairs = F.filter(F.transform(initials, lambda x, i: F.when(i > 0, F.concat(F.get(initials, i - 1), x))), lambda p: ~p.isin(*PAIRS))
    blocks = marked.groupBy("conv", "block").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    blocks = blocks.select(
        "conv", "block", tables.alias("table"), F.element_at(initials, 1).alias("first"), F.element_at(initials, -1).alias("last"), F.size(pairs).cast("long").alias("odd"),
        *[_count(F.col("turns.fault"), k).alias(k) for k in ("blank", "duplicate", "truncated")],
    )
    blocks = stored(blocks, "long-blocks")

    # tables in place of turns; ``path`` has the state after each block
    best = {s: F.struct(F.lit(0 if s == "e" else NEVER).cast("long").alias("cost"), F.lit("").alias("audit"), F.lit("").alias("path")) for s in STATES}

    def onward(now: Column, block: Column) -> Column:
        def way(a: str, b: str) -> Column:
            part = F.get(block["table"], F.lit(STATES.index(a)))[b]
            return F.struct((now[a]["cost"] + part["cost"]).alias("cost"), F.concat(now[a]["audit"], part["audit"]).alias("audit"), F.concat(now[a]["path"], F.lit(b)).alias("path"))

        return _four({b: F.least(*[way(a, b) for a in STATES]) for b in STATES})

    def finish(now: Column) -> Column:
        more = {"e": "", "a": "", "u": "I", "s": "II"}
        return F.least(*[F.struct((now[s]["cost"] + INSERT * len(i)).alias("cost"), F.concat(now[s]["audit"], F.lit(i)).alias("audit"), now[s]["path"].alias("path")) for s, i in more.items()])

    line = F.struct("block", "table", "first", "last")
    whole = blocks.groupBy("conv").agg(F.sort_array(F.collect_list(line)).alias("line"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "odd")])
    between = F.filter(F.transform("line", lambda x, i: F.when(i > 0, F.concat(F.get(F.col("line.last"), i - 1), x["first"]))), lambda p: ~p.isin(*PAIRS))
    whole = whole.withColumn("best", F.aggregate("line", _four(best), onward, finish)).withColumn("illegal", F.col("odd") + F.size(between))
    whole = stored(whole.select("conv", "blank", "duplicate", "truncated", "illegal", "best", F.col("line.block").alias("blocks")), "long-best")

    # texts of each block between the states that the best way passes
    path = F.concat(F.lit("e"), F.col("best.path"))
    ways = whole.select("conv", path.alias("path"), F.posexplode("blocks").alias("n", "block")).select(F.col("conv").alias("way"), F.col("block").alias("at"), F.substring("path", F.col("n") + 1, F.lit(1)).alias("from"), F.substring("path", F.col("n") + 2, F.lit(1)).alias("to"))
    row = reduce(lambda rest, s: F.when(F.col("from") == s, F.get("table", F.lit(STATES.index(s)))).otherwise(rest), STATES, F.lit(None))
    part = reduce(lambda rest, s: F.when(F.col("to") == s, row[s]["audit"]).otherwise(rest), STATES, F.lit(None).cast("string"))
    parts = blocks.withColumnRenamed("conv", "of").join(ways, F.col("of").eqNullSafe(F.col("way")) & (F.col("block") == F.col("at"))).select("of", F.col("block").alias("block_"), "from", part.alias("part"))
    texts = ordered.groupBy("conv", "block").agg(F.sort_array(F.collect_list(F.struct("at", "role", "text", F.substring("role", 1, 1).alias("initial")))).alias("turns"))
    texts = texts.join(parts, (F.col("block") == F.col("block_")) & F.col("conv").eqNullSafe(F.col("of")))
    lines = texts.select("conv", "block", rendered(F.col("turns"), F.col("part"), F.col("from")).alias("lines"))
    last = F.substring(path, -1, 1)
    tail = F.when(last == "u", F.array(F.lit("assistant:"))).when(last == "s", F.array(F.lit("user:"), F.lit("assistant:"))).otherwise(F.array().cast("array<string>"))
    lines = lines.unionByName(whole.select("conv", F.lit((1 << 63) - 1).alias("block"), tail.alias("lines")))
    digests = _digests(lines.withColumn("body", F.when(F.size("lines") > 0, F.array_join("lines", "\n"))), kind).withColumnRenamed("conv", "of")

    numbers = ordered.groupBy("conv").agg(F.max("turn").alias("most"), F.min("turn").alias("least"), F.countDistinct("turn").alias("distinct"))
    numbers = numbers.select(F.col("conv").alias("conv_"), _gaps(F.col("most"), F.col("least"), F.col("distinct")).alias("gaps"))
    out = whole.join(digests, F.col("conv").eqNullSafe(F.col("of"))).join(numbers, F.col("conv").eqNullSafe(F.col("conv_")))
    return out.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"), "repaired_sha256")


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Audit of every conversation of ``turns`` after ``damage``: ``conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``."""
    after = damage(turns, conv, turn, role, text)
    # damage doubles a turn at most
    long = stored(turns.groupBy(F.col(conv).alias("long")).count().where(F.col("count") > LONG // 2).select("long"), "long-conversations")
    if long.isEmpty():
        return _collected(after)
    named = F.col("conv").eqNullSafe(F.col("long"))
    apart = after.join(long, named, "left_semi")
    none = apart.groupBy("conv").agg(F.max("alive").alias("any")).where("NOT any").select("conv")
    rest = after.join(long, named, "left_anti").unionByName(apart.join(none.withColumnRenamed("conv", "none"), F.col("conv").eqNullSafe(F.col("none")), "left_semi"))
    return _collected(rest).unionByName(_in_blocks(apart))


def _best(*edits: str) -> str:
    return f"list_min([{', '.join(edits)}])"


def _plus(state: str, cost: str | int, letter: str) -> str:
    return f"{{'cost': {state}.cost + {cost}, 'audit': {state}.audit || {letter}}}"


#: DuckDB's form of ``repair`` over conversations: CRC-32 by its polynomial, a recursion over turns that carries the four (cost, audit) structs, and lines out of the audit.
REPAIR_SQL = f"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), coded AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ord(c)::BIGINT)),
    lambda x, b: list_reduce(list_prepend(xor(x, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, i: xor(v >> 1, (v & 1) * 3988292384))), 4294967295::BIGINT) % 20 AS code FROM src
), turns AS (
  SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE code WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM coded WHERE code <> 0
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core, left(role, 1) AS initial FROM turns)
), marked AS (
  SELECT *, CASE WHEN core = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY n) || initial NOT IN ('su', 'ua', 'au') AS odd FROM ordered
), convs AS (
  SELECT DISTINCT conv_id FROM conversations
), counts AS (
  SELECT c.conv_id, count(m.n) AS total, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE odd) AS illegal FROM convs c LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id
), walk AS (
  SELECT conv_id, 0::BIGINT AS n, {{'cost': 0::BIGINT, 'audit': ''}} AS e, {{'cost': {NEVER}::BIGINT, 'audit': ''}} AS s, {{'cost': {NEVER}::BIGINT, 'audit': ''}} AS u, {{'cost': {NEVER}::BIGINT, 'audit': ''}} AS a FROM convs
  UNION ALL
  SELECT conv_id, n, {_plus('e', DELETE, "'D'")}, CASE WHEN must OR initial <> 's' THEN {_plus('s', DELETE, "'D'")} ELSE {_best(_plus('s', DELETE, "'D'"), _plus('e', 'late', "'K'"))} END,
    CASE WHEN must THEN {_plus('u1', DELETE, "'D'")} ELSE {_best(_plus('u1', DELETE, "'D'"), *[_plus(b, f"CASE initial WHEN 'u' THEN 0 ELSE {REROLE} END + late", "CASE initial WHEN 'u' THEN 'K' ELSE 'R' END") for b in ('e', 's', 'a1')])} END,
    CASE WHEN must THEN {_plus('a1', DELETE, "'D'")} ELSE {_best(_plus('a1', DELETE, "'D'"), _plus('u1', f"CASE initial WHEN 'a' THEN 0 ELSE {REROLE} END + late", "CASE initial WHEN 'a' THEN 'K' ELSE 'R' END"))} END
  FROM (SELECT *, {_best('a', _plus('u1', INSERT, "'I'"))} AS a1 FROM (
    SELECT w.conv_id, m.n, w.e, w.s, w.a, {_best('w.u', *[_plus(f'w.{b}', INSERT, "'I'") for b in 'esa'])} AS u1, m.initial, coalesce(m.fault IN ('blank', 'duplicate'), false) AS must, CASE m.fault WHEN 'truncated' THEN {TRUNCATED} ELSE 0 END AS late
    FROM walk w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.n = w.n + 1))
), ends AS (
  SELECT c.*, {_best('e', 'a', *[_plus(_plus(f'w.{b}', INSERT, "'I'").join(('(', ')')), INSERT, "'I'") for b in 's'], _plus('w.u', INSERT, "'I'"))} AS best
  FROM counts c JOIN walk w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.n = c.total
), letters AS (
  SELECT conv_id, unnest(string_split(best.audit, '')) AS letter, generate_subscripts(string_split(best.audit, ''), 1) AS p, best.audit AS audit FROM ends WHERE best.audit <> ''
), placed AS (
  SELECT *, length(replace(left(audit, p), 'I', '')) AS row_, length(replace(left(audit, p), 'D', '')) AS place FROM letters
), joined AS (
  SELECT p.*, m.role, m.text, m.initial, coalesce(bool_or(p.place = 1 AND p.letter = 'K' AND m.initial = 's') OVER (PARTITION BY p.conv_id), false) AS system
  FROM placed p LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.n = p.row_ AND p.letter <> 'I' WHERE p.letter <> 'D'
), lines AS (
  SELECT conv_id, string_agg(CASE letter WHEN 'K' THEN role || ':' || text ELSE CASE WHEN (place - CASE WHEN system THEN 1 ELSE 0 END) % 2 = 1 THEN 'user:' ELSE 'assistant:' END || CASE letter WHEN 'R' THEN text ELSE '' END END, chr(10) ORDER BY p) AS body
  FROM joined GROUP BY conv_id
)
SELECT e.conv_id, gaps, blank, duplicate, truncated, illegal, best.cost AS cost, best.audit AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM ends e LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM e.conv_id
"""
