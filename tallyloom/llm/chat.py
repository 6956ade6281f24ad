"""Chat formatting from event logs: fold deltas, edits and regenerations into final messages, then render them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, named, quoted

#: Control strings of the template. Each begins with < or [, which never stands before anything but a backslash in escaped text.
OPEN, ROLE_END, CLOSE = "<s>[INST:", "] ", " [/INST]</s>\n"
#: Code points of a streamed delta.
DELTA = 512
EVENTS = "conv_id long, turn long, part long, seq long, kind string, role string, text string"


def escape(c: Column) -> Column:
    """A backslash after every <, [, ] and backslash."""
    return F.regexp_replace(c, r"([<\[\]\\])", r"$1\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[\]\\])\\", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, part, role, text) of an event log (``EVENTS``).

    Events of a conversation are taken by ``seq`` (ties: by kind, role, text). ``message`` sets a message's role and
    text, ``delta`` adds to the text, ``edit`` replaces it, ``regenerate`` empties it for the deltas that follow and
    takes back all later turns written before it, ``delete`` takes the message back; an unknown kind changes nothing.
    A null text or role is empty, a null ``part`` is 0. A message exists if any event but ``delete`` ended it. Nulls in
    conv_id or turn form groups of their own, before all others. Folding is by message, so a conversation that holds a
    third of all events is shared out; only numbers (turns and sequence numbers, no texts) of conversations that
    regenerate pass one task in order, to find the turns that are taken back.
    """
    e = events.select("conv_id", "turn", F.coalesce("part", F.lit(0).cast("long")).alias("part"), F.struct("seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("e"))
    log = e.groupBy("conv_id", "turn", "part").agg(F.sort_array(F.collect_list("e")).alias("log"))
    kind = lambda e: F.coalesce(e["kind"], F.lit(""))
    last = lambda keep: F.try_element_at(F.filter("log", keep), F.lit(-1))
    role = F.coalesce(last(lambda e: (kind(e) == "message") | (e["role"] != ""))["role"], F.lit(""))
    alive = F.coalesce(kind(last(lambda e: kind(e).isin("message", "edit", "delta", "regenerate", "delete"))) != "delete", F.lit(False)) & F.exists("log", lambda e: kind(e).isin("message", "edit", "delta", "regenerate"))
    # what was written before the last event that sets the text anew no longer counts: one look back, then one join
    back = F.array_position(F.transform(F.reverse("log"), lambda e: kind(e).isin("message", "edit", "regenerate", "delete")), True)
    tail = F.when(back > 0, F.slice("log", F.size("log") - back.cast("int") + 1, back.cast("int"))).otherwise(F.col("log"))
    text = F.array_join(F.transform(F.filter(tail, lambda e: kind(e).isin("message", "edit", "delta")), lambda e: e["text"]), "")
    m = F.struct(role.alias("role"), text.alias("text"), alive.alias("alive"))
    folded = log.select("conv_id", "turn", "part", m.alias("m")).filter("m.alive").select("conv_id", "turn", "part", "m.role", "m.text")
    gone = _taken_back(events)
    if gone is None:
        return folded
    same = [folded[k].eqNullSafe(gone[f"gone_{k}"]) for k in ("conv_id", "turn", "part")]
    return folded.join(gone, same[0] & same[1] & same[2], "left_anti")


def _taken_back(events: DataFrame) -> DataFrame | None:
    """Messages (gone_conv_id, gone_turn, gone_part) whose last event came before an earlier turn was regenerated; None if
    there are none."""
    ws = Workspace(events.sparkSession, "regenerated")
    e = events.select("conv_id", "turn", F.coalesce("part", F.lit(0).cast("long")).alias("part"), "seq", "kind")
    again = ws.table(e.filter("kind = 'regenerate'").groupBy("conv_id", "turn").agg(F.max("seq").alias("again")), "again")
    if not again.limit(1).count():
        return None
    convs = again.select(F.col("conv_id").alias("c")).distinct()
    last = e.join(convs, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi").groupBy("conv_id", "turn", "part").agg(F.max("seq").alias("seq"))
    rows = last.withColumn("again", F.lit(None).cast("long")).unionByName(again.select("conv_id", "turn", F.lit(None).cast("long").alias("part"), F.lit(None).cast("long").alias("seq"), "again"))
    # a regenerated message of the same turn leaves its sisters alone: compare with earlier turns only
    earlier = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.max("again").over(earlier)).filter("part IS NOT NULL AND before IS NOT NULL AND coalesce(seq <= before, false)")
    return ws.table(rows.select(*[F.col(k).alias(f"gone_{k}") for k in ("conv_id", "turn", "part")]), "gone")


def render(messages: DataFrame) -> DataFrame:
    """Messages plus ``piece`` (the message in the template) and the span ``loss_start``, ``loss_end`` in code points.

    A conversation's formatted text is its pieces in order (turn, part), nothing between. The span is an assistant's
    escaped text, else empty.
    """
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(ROLE_END))
    body = escape(F.col("text"))
    learn = F.col("role") == "assistant"
    m = messages.withColumns({"__head": head, "__body": body})
    return m.select(
        "conv_id", "turn", "part", F.concat("__head", "__body", F.lit(CLOSE)).alias("piece"),
        F.when(learn, F.char_length("__head")).otherwise(0).cast("long").alias("loss_start"),
        F.when(learn, F.char_length("__head") + F.char_length("__body")).otherwise(0).cast("long").alias("loss_end"),
    )


def write_pieces(pieces: DataFrame, path: str) -> None:
    """One Parquet row a message, ordered by conversation and turn; a long conversation spans several files."""
    pieces.repartitionByRange("conv_id", "turn", "part").sortWithinPartitions("conv_id", "turn", "part").write.mode("overwrite").parquet(path)


def parse_pieces(pieces: DataFrame) -> DataFrame:
    """Role, text and learnt text of each written piece, from the piece and its span alone."""
    role_at = len(OPEN) + 1
    end = F.locate(ROLE_END, F.col("piece"), role_at)
    role = F.substring("piece", F.lit(role_at), end - role_at)
    text = F.substring("piece", end + len(ROLE_END), F.char_length("piece") - end - len(ROLE_END) - len(CLOSE) + 1)
    learnt = F.substring("piece", (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    return pieces.select("conv_id", "turn", "part", unescape(role).alias("role"), unescape(text).alias("text"), unescape(learnt).alias("learnt"), F.char_length("piece").cast("long").alias("chars"))


def conversation_digests(parsed: DataFrame) -> DataFrame:
    """One row a conversation. SHA-256 takes its input in order, so rows stream by (conversation, turn) through the
    digest; a task holds one Arrow batch however long a conversation is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        at, n, chars, learnt_n, turns, learnt = None, 0, 0, 0, None, None
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                out.clear()

        for b in batches:
            for conv, role, text, lt, c in zip(*(b.column(b.schema.get_field_index(x)).to_pylist() for x in ("conv_id", "role", "text", "learnt", "chars")), strict=True):
                if turns is None or conv != at:
                    if turns is not None:
                        out.append((at, n, turns.hexdigest(), learnt_n, learnt.hexdigest(), chars))
                    at, n, chars, learnt_n, turns, learnt = conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                n, chars, learnt_n = n + 1, chars + c, learnt_n + len(lt)
                turns.update(f"{role}\n{text}\n".encode())
                learnt.update(lt.encode())
            yield from flush()
        if turns is not None:
            out.append((at, n, turns.hexdigest(), learnt_n, learnt.hexdigest(), chars))
        yield from flush()

    ordered = parsed.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "part")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def as_events(conversations: DataFrame) -> DataFrame:
    """The log that a chat service would have written of a table of turns (conv_id, turn, role, text); rows that share a
    turn are its parts, by role and text.

    An assistant's message begins empty and is streamed in deltas of ``DELTA`` code points; every third one was first answered by a draft and regenerated. Any other message is sent half written and then
    edited. ``seq`` counts up within the conversation by turn and part. Turns of 2**20 and more all come after those
    below it and are never regenerated.
    """
    tie = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    own = lambda name: F.col(quoted(named(conversations, name)))
    rows = conversations.select(own("conv_id").cast("long").alias("conv_id"), own("turn").cast("long").alias("turn"), own("role").cast("string").alias("role"), F.coalesce(own("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"part": (F.row_number().over(tie) - 1).cast("long"), "n": F.char_length("text")})
    nothing = F.lit(None).cast("string")
    event = lambda kind, text, role=nothing: F.struct(F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    size = F.lit(DELTA)
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.greatest("n", F.lit(1)) - 1) / size).cast("int")), lambda i: event("delta", F.substring("text", i * size + 1, size)))
    streamed = F.concat(F.array(event("message", F.lit(""), F.col("role"))), pieces)
    again = F.concat(F.array(event("message", F.lit("draft"), F.col("role")), event("delta", F.lit(" of an answer")), event("regenerate", nothing)), pieces)
    edited = F.array(event("message", F.substring("text", F.lit(1), F.floor(F.col("n") / 2).cast("int")), F.col("role")), event("edit", F.col("text")))
    early = F.col("turn").between(0, (1 << 20) - 1)
    drafted = early & (F.pmod(F.xxhash64("conv_id", "turn", "part"), F.lit(3)) == 0)
    log = F.when((F.col("role") == "assistant") & drafted, again).when(F.col("role") == "assistant", streamed).otherwise(edited)
    # later turns are written after all events of earlier ones, so a regeneration takes none of them back
    base = F.when(early, F.col("turn") * (1 << 42) + F.least("part", F.lit((1 << 20) - 1)) * (1 << 22)).when(F.col("turn") > 0, F.lit(1 << 62)).otherwise(F.lit(0).cast("long"))
    out = rows.select("conv_id", "turn", "part", base.alias("base"), F.posexplode(log).alias("at", "e"))
    return out.select("conv_id", "turn", "part", (F.col("base") + F.col("at")).alias("seq"), "e.kind", "e.role", "e.text")


def format_conversations(events: DataFrame) -> DataFrame:
    """Fold, render, write and read back: the written pieces of all conversations (see ``render``)."""
    ws = Workspace(events.sparkSession, "chat")
    pieces = render(fold_events(events))
    write_pieces(pieces, ws.at("pieces"))
    return ws.read("pieces", pieces)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    log = Workspace(spark, "events").table(as_events(rows.unionByName(own)), "log")
    return conversation_digests(parse_pieces(format_conversations(log)))


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(regexp_replace(role, '([<\[\]\\])', '\1\\', 'g')) + length(regexp_replace(text, '([<\[\]\\])', '\1\\', 'g')) + 24) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""
