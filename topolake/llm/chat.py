"""Chat formatting by event-sourced reconstruction.

A log of events (conv_id, seq, message, kind, role, text) is partitioned by conversation, sorted by sequence and folded:
`start` opens a message with its role, `delta` appends text, `edit` replaces the text so far, `regenerate` empties it for
new deltas, `retract` takes the message back, `end` says that nothing more comes. Messages stand in the order they were opened. The folded turns are rendered
by a template that marks turns, with a loss mask over the assistants' texts.

A turn is <|im_start|>role, a line break, the text, <|im_end|> and a line break. Control strings of this and other common
templates inside texts get a backslash after their first sign, and such a string that already has backslashes there gets
one more; removing one again gives the text back exactly, and no text can pose as a mark.

The fold streams: Spark sorts a partition, spilling where it must, and Python holds one batch of rows and the open
message, however long a conversation is. Rendered text leaves in pieces of bounded size, (conv_id, piece, text, mask),
which are read back in the same order; mask lists the loss spans as offsets in the piece.

Defined results: a null text is empty; a null role is the empty role; a null conv_id is a conversation of its own; rows of
equal turn follow by role, then text; repeated rows are turns each; events for a message that isn't open are ignored; a
conversation without messages has no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .util import batches, own, shared_dir

START, END = "<|im_start|>", "<|im_end|>"
#: The strings that chat templates in common use take as control marks.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<|begin_of_text|>", "<|end_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>", "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>"]
#: Signs of rendered text in a piece.
PIECE = 1 << 20


def _pattern() -> re.Pattern:
    rest = sorted({re.escape(c.lstrip("<[")) for c in CONTROL}, key=len, reverse=True)
    return re.compile(r"([<\[])(\\*)(?=(?:" + "|".join(rest) + "))")


_MARK = _pattern()


def escape(text: str) -> str:
    return _MARK.sub(lambda m: f"{m[1]}{m[2]}\\", text)


def unescape(text: str) -> str:
    return _MARK.sub(lambda m: m[1] + m[2][:-1], text)


def fold(events: Iterable[tuple]) -> Iterator[tuple]:
    """(conv_id, role, text) of each final message, from events (conv_id, message, kind, role, text) in order.

    Messages may overlap; one leaves as soon as all that were opened before it have been closed by `end`, or at the end
    of its conversation.
    """
    conv, open_, closed, first = None, {}, set(), True  # open_ keeps the order in which messages were opened

    def flush(all_: bool) -> Iterator[tuple]:
        while open_ and (all_ or next(iter(open_)) in closed):
            message = next(iter(open_))
            closed.discard(message)
            role, parts = open_.pop(message)
            yield conv, role, "".join(parts)

    for c, message, kind, role, text in events:
        if first or c != conv:
            yield from flush(True)
            conv, first = c, False
            closed.clear()
        if kind == "start":
            if message not in open_:
                open_[message] = (role or "", [])
        elif message in open_ and message not in closed:
            parts = open_[message][1]
            if kind == "delta":
                parts.append(text or "")
            elif kind == "edit":
                parts[:] = [text or ""]
            elif kind == "regenerate":
                parts.clear()
            elif kind == "retract":
                del open_[message]
                yield from flush(False)
            elif kind == "end":
                closed.add(message)
                yield from flush(False)
    yield from flush(True)


def render(role: str, text: str) -> tuple[str, tuple[int, int] | None]:
    """A turn's rendered text, and where in it the loss counts."""
    head = f"{START}{escape(role.replace(chr(92), chr(92) * 2).replace(chr(10), chr(92) + 'n'))}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", (len(head), len(head) + len(body)) if role == "assistant" else None


def _role(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text))


def format_events(events: DataFrame) -> DataFrame:
    """(conv_id, piece, text, mask) of a log of events (conv_id, seq, message, kind, role, text)."""
    shared_dir(events.sparkSession)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    schema = pa.schema([("conv_id", pa.int64()), ("piece", pa.int32()), ("text", pa.string()), ("mask", pa.list_(span))])

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in it:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    def pieces(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        conv, number, held, mask, size, first = None, 0, [], [], 0, True

        def piece() -> dict:
            return {"conv_id": conv, "piece": number, "text": "".join(held), "mask": mask}

        for c, role, text in fold(rows(it)):
            if first or c != conv:
                if held:
                    yield piece()
                conv, number, held, mask, size, first = c, 0, [], [], 0, False
            turn, loss = render(role, text)
            at = 0
            while at < len(turn):
                part = turn[at : at + PIECE - size]
                if loss and loss[0] <= at + len(part) and loss[1] >= at:
                    start, end = max(loss[0] - at, 0), min(loss[1] - at, len(part))
                    if start < end or loss[0] == loss[1]:
                        mask.append({"start": size + start, "end": size + end})
                held.append(part)
                size, at = size + len(part), at + len(part)
                if size >= PIECE:
                    yield piece()
                    number, held, mask, size = number + 1, [], [], 0
        if held:
            yield piece()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(pieces(it), schema, 500, 8 << 20, lambda r: len(r["text"]))

    log = own(events, "conv_id", "seq", "message", "kind", "role", "text")
    dealt = log.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "kind", "role", "text")
    return dealt.select(F.col("conv_id").cast("long"), F.col("message").cast("string"), "kind", "role", "text").mapInArrow(run, "conv_id long, piece int, text string, mask array<struct<start:int,end:int>>")


def events_of(turns: DataFrame) -> DataFrame:
    """A log whose fold gives the finished turns (conv_id, turn, role, text) again.

    By a hash of its place a turn is streamed in two deltas, or edited after the first one, or regenerated after it; or
    another message, which is then retracted, comes before it.
    """
    base = own(turns, "conv_id", "turn", "role", "text").withColumn("text", F.coalesce("text", F.lit("")))
    rn = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    half = F.floor(F.char_length("text") / 2).cast("int")
    none = F.lit(None).cast("string")
    way, turn, draft = F.pmod(F.xxhash64("conv_id", "rn"), F.lit(4)), F.col("rn").cast("string"), F.concat(F.col("rn").cast("string"), F.lit("x"))
    begin, rest = F.left("text", half), F.substring("text", half + 1, F.char_length("text"))
    steps = [
        (way == 3, draft, "start", F.col("role"), none), (way == 3, draft, "delta", none, begin), (way == 3, draft, "retract", none, none),
        (F.lit(True), turn, "start", F.col("role"), none), (F.lit(True), turn, "delta", none, begin), (way == 1, turn, "edit", none, F.col("text")), (way == 2, turn, "regenerate", none, none),
        (way == 2, turn, "delta", none, begin), (way != 1, turn, "delta", none, rest), (F.lit(True), turn, "end", none, none),
    ]
    log = F.array(*(F.struct((F.col("rn") * len(steps) + i).alias("seq"), message.alias("message"), F.when(has, F.lit(kind)).alias("kind"), role.alias("role"), text.alias("text")) for i, (has, message, kind, role, text) in enumerate(steps)))
    return base.withColumn("rn", rn).select("conv_id", F.explode(F.filter(log, lambda e: e["kind"].isNotNull())).alias("e")).select("conv_id", "e.*")


def turns_of(pieces: Iterable[tuple]) -> Iterator[tuple]:
    """(conv_id, role, text, loss text or None, rendered length) of each turn, parsed from pieces (conv_id, text, mask) in order.

    Every sign is looked at a bounded number of times, also where a piece has thousands of turns or a turn many pieces.
    """
    conv, held, size, tail, base, first = None, [], 0, "", 0, True  # held: text that begins a turn and has no end yet, of `size` signs
    spans: deque[tuple[int, int]] = deque()
    for c, text, mask in pieces:
        if first or c != conv:
            conv, held, size, tail, base, first = c, [], 0, "", 0, False
            spans.clear()
        spans.extend((base + size + m["start"], base + size + m["end"]) for m in mask)
        seen = tail + text  # a mark may lie across pieces
        at, tail = seen.find(END), seen[-len(END) :]
        if at < 0 or at + len(END) == len(seen):
            held.append(text)
            size += len(text)
            continue
        buffer, used = "".join([*held, text]), 0
        while (end := buffer.find(END, used)) >= 0 and len(buffer) > end + len(END):
            line = buffer.index("\n", used)
            stop = end + len(END) + 1
            loss = []
            while spans and spans[0][0] < base + stop:
                s, e = spans.popleft()
                loss.append(buffer[s - base : e - base])
            yield conv, _role(buffer[used + len(START) : line]), unescape(buffer[line + 1 : end]), unescape("".join(loss)) if loss else None, stop - used
            used = stop
        base, held, size = base + used, [buffer[used:]], len(buffer) - used


def read_back(pieces: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) per conversation of rendered pieces."""
    shared_dir(pieces.sparkSession)
    ddl = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in it:
            yield from zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True)

    def conversations(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        conv, row, turns, loss = None, None, None, None

        def done() -> dict:
            return row | {"turns_sha256": turns.hexdigest(), "loss_sha256": loss.hexdigest()}

        for c, role, text, masked, length in turns_of(rows(it)):
            if row is None or c != conv:
                if row is not None:
                    yield done()
                conv, turns, loss = c, hashlib.sha256(), hashlib.sha256()
                row = {"conv_id": c, "n_turns": 0, "loss_chars": 0, "formatted_chars": 0}
            turns.update(f"{role}\n{text}\n".encode())
            row["n_turns"] += 1
            row["formatted_chars"] += length
            if masked is not None:
                loss.update(masked.encode())
                row["loss_chars"] += len(masked)
        if row is not None:
            yield done()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(conversations(it), schema)

    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(run, ddl)
