"""Chat formatting with typed content parts (operator 13).

A message is a sequence of parts. A visitor flattens them in order: text is escaped, each attachment (image, audio, document) becomes a
placeholder, and its reference is recorded with the number of tokens that the placeholder expands to. The template marks where a
message begins and ends. Strings in a text that look like marks or placeholders are escaped by a backslash behind their first sign, and
strings that look escaped get one more, so that the reader finds back every text as it was.

Formatting and reading work on a message at a time. A conversation is the messages' segments in a row; its digests are taken from a stream of
sorted rows, so that a conversation of any length needs the memory of one message.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, pick

#: What stands before and behind a message's parts, by role. Other roles are named in a mark of their own.
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("", "</s>")}
ROLE, ROLE_END, OTHER_END = "[ROLE]", "[/ROLE]", "[/MSG]"
ATTACHED = ("image", "audio", "document")
#: All that is a mark, behind its first sign. No mark holds another's first sign, so none can arise where texts and marks meet.
BODY = r"(?:/?s>|/?INST\]|/?SYS\]|/?ROLE\]|/?MSG\]|(?:image|audio|document):[0-9]+\])"
MARK = re.compile(rf"[<\[]{BODY}")
ESCAPE, UNESCAPE = re.compile(rf"([<\[])(\\*{BODY})"), re.compile(rf"([<\[])\\(\\*{BODY})")
#: The role whose text is learned.
LEARNED = "assistant"

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


@dataclass
class Costs:
    """Tokens that an attachment's placeholder expands to: a token for each patch of an image, for each stretch of sound, some for each page. Of
    an attachment whose size isn't told, one unit counts."""

    patch: int = 28
    a_second: float = 25.0
    a_page: int = 512

    def image(self, width: int | None, height: int | None) -> int:
        side = lambda x: max(1, math.ceil((x or 0) / self.patch))
        return side(width) * side(height)

    def audio(self, seconds: float | None) -> int:
        return max(1, math.ceil((seconds or 0.0) * self.a_second))

    def document(self, pages: int | None) -> int:
        return max(1, pages or 0) * self.a_page


@dataclass
class Visitor:
    """Flattens the parts of one message. spans: where its texts lie in `out`, in code points, texts in a row as one (so that no mark arises where
    they meet); attachments: (number, kind, ref, tokens)."""

    costs: Costs
    out: list[str] = field(default_factory=list)
    held: list[str] = field(default_factory=list)
    at: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[tuple[int, str, str, int]] = field(default_factory=list)

    def put(self, piece: str) -> None:
        self.out.append(piece)
        self.at += len(piece)

    def visit(self, part: dict) -> None:
        kind = (part.get("kind") or "text").lower()
        getattr(self, f"visit_{kind}" if kind in ("text", *ATTACHED) else "visit_other")(part)

    def visit_text(self, part: dict) -> None:
        self.held.append(part.get("text") or "")

    def end_text(self) -> None:
        piece, before = escaped("".join(self.held)), self.at
        self.held.clear()
        if piece:
            self.put(piece)
            self.spans.append((before, self.at))

    def visit_image(self, part: dict) -> None:
        self.attach("image", part, self.costs.image(part.get("width"), part.get("height")))

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, self.costs.audio(part.get("seconds")))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, self.costs.document(part.get("pages")))

    def visit_other(self, part: dict) -> None:
        """A part of an unknown kind is kept by its text, if it has one."""
        self.visit_text(part)

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        self.end_text()
        number = len(self.attachments)
        self.put(f"[{kind}:{number}]")
        self.attachments.append((number, kind, part.get("ref") or "", tokens))


def escaped(text: str) -> str:
    return ESCAPE.sub(r"\1\\\2", text) if "<" in text or "[" in text else text


def unescaped(text: str) -> str:
    return UNESCAPE.sub(r"\1\2", text) if "\\" in text else text


def format_message(role: str, parts: list[dict], costs: Costs) -> Visitor:
    """One message in its marks. An unknown role is named, escaped, in a mark."""
    visitor = Visitor(costs)
    head, tail = MARKS.get(role, (f"{ROLE}{escaped(role)}{ROLE_END}", OTHER_END))
    visitor.put(head)
    for part in parts:
        visitor.visit(part)
    visitor.end_text()
    visitor.put(tail)
    return visitor


def read(formatted: str) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """(role, parts) of each message of a formatted text; a part is ('text', text) or (kind, number)."""
    role, at, parts = LEARNED, 0, []
    opens, closes = {h: r for r, (h, _) in MARKS.items() if h}, {t for _, t in MARKS.values()} | {OTHER_END}
    for m in MARK.finditer(formatted):
        piece, mark = formatted[at : m.start()], m[0]
        at = m.end()
        if mark == ROLE_END:
            role = unescaped(piece)
            continue
        if piece:
            parts.append(("text", unescaped(piece)))
        if mark in closes:
            yield role, parts
            role, parts = LEARNED, []
        elif mark in opens:
            role = opens[mark]
        elif mark != ROLE:
            kind, _, number = mark[1:-1].partition(":")
            parts.append((kind, number))


def json_parts(content: Column) -> Column:
    """Typed parts of a message's content as JSON, an array of objects with `type` and the fields of PART; anything else is one text part."""
    found = F.from_json(content, "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>")
    listed = F.transform(found, lambda p: F.struct(p["type"].alias("kind"), *[p[c].alias(c) for c in ("text", "ref", "width", "height", "seconds", "pages")]))
    return F.when(F.startswith(F.ltrim(content), F.lit("[")) & (F.size(found) > 0) & F.forall(found, lambda p: p["type"].isNotNull()), listed).otherwise(text_part(content))


def text_part(text: Column) -> Column:
    """One text part."""
    rest = [F.lit(None).cast(kind).alias(c) for c, kind in (x.split(":") for x in PART[7:-1].split(",")[2:])]
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), *rest))


SEGMENT = "role string, segment string, loss array<struct<start:int,end:int>>, attachments array<struct<number:int,kind:string,ref:string,tokens:long>>, expanded long"


def format_turns(turns: DataFrame, costs: Costs | None = None) -> DataFrame:
    """(conv_id, turn, role, segment, loss, attachments, expanded) of each message (conv_id, turn, role, parts).

    segment is the message in its marks; loss says where the texts to learn lie in it (those of the assistant, without marks and placeholders);
    attachments are the placeholders' references, numbered within the message; expanded is the sum of the tokens they expand to. A null role
    is the empty one; null parts are none. Repeated rows stay; no rows give no rows; other columns are not read.
    """
    rows = pick(turns, "conv_id", "turn", "role", "parts")
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    costs = costs or Costs()
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    attachment = pa.struct([("number", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles = [r or "" for r in batch.column("role").to_pylist()]
            done = [format_message(role, parts or [], costs) for role, parts in zip(roles, batch.column("parts").to_pylist())]
            loss = [[{"start": s, "end": e} for s, e in v.spans] if role == LEARNED else [] for role, v in zip(roles, done)]
            files = [[dict(zip(("number", "kind", "ref", "tokens"), a)) for a in v.attachments] for v in done]
            columns = [batch.column("conv_id"), batch.column("turn"), pa.array(roles), pa.array(["".join(v.out) for v in done], pa.string()), pa.array(loss, pa.list_(span)), pa.array(files, pa.list_(attachment)), pa.array([sum(a[3] for a in v.attachments) for v in done], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "turn", "role", "segment", "loss", "attachments", "expanded"])

    return map_arrow(rows, run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, {SEGMENT}")


class _Conversation:
    """Digests of one conversation as its segments come."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.attached = self.expanded = 0

    def add(self, segment: str, loss: list[dict], attached: int, expanded: int) -> None:
        for role, parts in read(segment):
            self.n_turns += 1
            self.turns.update(f"{role}\n{''.join(x for kind, x in parts if kind == 'text')}\n".encode())
        for span in loss:
            text = unescaped(segment[span["start"] : span["end"]])
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        self.chars += len(segment)
        self.attached += attached
        self.expanded += expanded


def read_back(segments: DataFrame) -> DataFrame:
    """What the output of format_turns holds, by conversation: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
    n_attachments, attachment_tokens).

    Messages are taken by turn (a null turn first; of equal turns by their segments). They are sorted within partitions and streamed, a message at a
    time: only the digests of a conversation, which no two tasks could share, are one task's. Rows without conv_id are one conversation.
    """
    kind = segments.schema["conv_id"].dataType.simpleString()
    rows = pick(segments, "conv_id", "turn", "segment", "loss", "attachments", "expanded")
    rows = rows.select("conv_id", "turn", "segment", "loss", F.size("attachments").alias("attached"), "expanded")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "attachment_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, None, []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out))
            types = [ids, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        def end() -> None:
            out.append((now, held.n_turns, held.turns.hexdigest(), held.loss_chars, held.loss.hexdigest(), held.chars, held.attached, held.expanded))

        for batch in batches:
            ids = batch.schema.field("conv_id").type
            for conv, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss", "attached", "expanded"))):
                if held is None or conv != now:
                    if held is not None:
                        end()
                    now, held = conv, _Conversation()
                held.add(*row)
            if len(out) >= 1000:
                yield flush()
                out = []
        if held is not None:
            end()
            yield flush()

    return map_arrow(rows, run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, attachment_tokens long")


def as_messages(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, parts): plain texts as messages of one text part each."""
    return pick(conversations, "conv_id", "turn", "role", "text").select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts"))


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -1: two messages made of control strings."""
    said = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
