"""Chat formatting of typed content parts.

A turn is a list of parts (text, image, audio, document).  A visitor flattens the parts in order: a text is escaped and
written out, any other part becomes a placeholder, its reference is recorded with the place it has in the output, and the
tokens that it stands for when expanded are counted.  Turns are marked by control strings; the loss mask covers exactly
the text of assistant turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The control strings of common chat templates.  Inside texts they are escaped.
CONTROL = (
    "<|im_start|>", "<|im_end|>", "<|image|>", "<|audio|>", "<|document|>", "<|system|>", "<|user|>", "<|assistant|>",
    "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)
#: Stands behind the first character of a control string, or of one with such marks, in the output only.
MARK = "\u2060"
_ESCAPE = re.compile("|".join(f"{re.escape(c[0])}{MARK}*{re.escape(c[1:])}" for c in CONTROL))
_UNESCAPE = re.compile("|".join(f"{re.escape(c[0])}{MARK}+{re.escape(c[1:])}" for c in CONTROL))
#: Inside a role a line feed, which ends it in the output, is written as these two characters, and a backslash as two.
_ROLE = {"\\": "\\\\", "\n": "\\n"}
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    """``text`` without control strings; ``unescape`` gives it back whatever it holds."""
    return _ESCAPE.sub(lambda m: f"{m[0][0]}{MARK}{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[0][0] + m[0][2:], text)


def escape_role(role: str) -> str:
    return escape(role.translate(str.maketrans(_ROLE)))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@dataclass(frozen=True)
class Text:
    text: str

    def accept(self, visitor: Visitor) -> None:
        visitor.text(self)


@dataclass(frozen=True)
class Image:
    ref: str
    width: int = 0
    height: int = 0

    def accept(self, visitor: Visitor) -> None:
        visitor.image(self)


@dataclass(frozen=True)
class Audio:
    ref: str
    seconds: float = 0

    def accept(self, visitor: Visitor) -> None:
        visitor.audio(self)


@dataclass(frozen=True)
class Document:
    ref: str
    pages: int = 0

    def accept(self, visitor: Visitor) -> None:
        visitor.document(self)


Part = Text | Image | Audio | Document
#: A part as a column: the fields of other kinds are null.
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def part_of(row: dict) -> Part:
    """A typed part of the fields of a column; a null reference is empty and a null size 0."""
    kind, get = row["kind"], lambda name, none: none if row.get(name) is None else row[name]
    if kind == "text":
        return Text(get("text", ""))
    if kind == "image":
        return Image(get("ref", ""), get("width", 0), get("height", 0))
    if kind == "audio":
        return Audio(get("ref", ""), get("seconds", 0.0))
    if kind == "document":
        return Document(get("ref", ""), get("pages", 0))
    raise ValueError(f"no such kind of part: {kind}")


@dataclass
class Visitor:
    """Flattens parts; ``attachments``: kind, reference, place in the turn's output and expanded tokens, in order; ``texts``: where texts are."""

    patch: int = 14
    audio_rate: int = 25
    page_tokens: int = 1024
    out: list[str] = field(default_factory=list)
    attachments: list[tuple[str, str, int, int]] = field(default_factory=list)
    texts: list[tuple[int, int]] = field(default_factory=list)
    size: int = 0

    def _write(self, s: str) -> None:
        self.out.append(s)
        self.size += len(s)

    def _attach(self, kind: str, ref: str, tokens: int) -> None:
        self.attachments.append((kind, ref, self.size, tokens))
        self._write(f"<|{kind}|>")

    def text(self, part: Text) -> None:
        # Two texts in a row are one, so that no control string arises where they meet.
        self.texts.append((self.size, self.size + len(part.text)))
        self._write(part.text)

    def image(self, part: Image) -> None:
        self._attach("image", part.ref, -(-part.width // self.patch) * -(-part.height // self.patch))

    def audio(self, part: Audio) -> None:
        self._attach("audio", part.ref, int(-(-part.seconds * self.audio_rate // 1)))

    def document(self, part: Document) -> None:
        self._attach("document", part.ref, part.pages * self.page_tokens)


def _joined(parts: Iterable[Part]) -> Iterator[Part]:
    held = ""
    for p in parts:
        if isinstance(p, Text):
            held += p.text
            continue
        if held:
            yield Text(escape(held))
            held = ""
        yield p
    if held:
        yield Text(escape(held))


def format_turn(role: str, parts: Iterable[Part]) -> tuple[str, list[tuple[int, int]], list[tuple[str, str, int, int]]]:
    """One turn's output; where in it the loss mask lies, which leaves placeholders out; its attachments with their places in the output."""
    head = f"<|im_start|>{escape_role(role)}\n"
    visitor = Visitor()
    for p in _joined(parts):
        p.accept(visitor)
    body = "".join(visitor.out)
    mask = [(len(head) + a, len(head) + b) for a, b in visitor.texts] if role == "assistant" else []
    return f"{head}{body}<|im_end|>\n", mask, [(k, r, len(head) + at, n) for k, r, at, n in visitor.attachments]


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of formatted turns; placeholders stay where they are."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def format_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None) -> DataFrame:
    """Each row as a formatted turn.

    A turn's content is its text or, where ``parts_col`` names a column and that is not null, its parts: an array of structs as
    ``PART`` lists them, of which further or lacking fields are as null ones, and null parts are left out.  Returns ``conv_id``,
    ``turn``, ``formatted``, ``mask`` (array of start and end in ``formatted``) and ``attachments`` (array of kind, reference,
    place in ``formatted`` and expanded tokens, in order).  A null text is empty and a null role is the empty role; an unknown
    kind is an error; null ids and repeated rows stay; a table may be empty.  Further columns are not read.
    """
    attached = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())]))

    def run(batches):
        for b in batches:
            made = []
            for role, text, parts in zip(*[b.column(c).to_pylist() for c in ("role", "text", "parts")], strict=True):
                content = [Text(text or "")] if parts is None else [part_of(x) for x in parts if x is not None]
                made.append(format_turn(role or "", content))
            cols = [b.column("conv_id"), b.column("turn"), pa.array([m[0] for m in made], pa.string())]
            cols.append(pa.array([[list(x) for x in m[1]] for m in made], pa.list_(pa.list_(pa.int64()))))
            cols.append(pa.array([[dict(zip(("kind", "ref", "at", "tokens"), x, strict=True)) for x in m[2]] for m in made], attached))
            yield pa.RecordBatch.from_arrays(cols, names=["conv_id", "turn", "formatted", "mask", "attachments"])

    parts = F.col(parts_col) if parts_col else F.lit(None).cast(f"array<{PART}>")
    some = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"), parts.alias("parts"))
    return some.mapInArrow(run, "conv_id long, turn long, formatted string, mask array<array<long>>, attachments array<struct<kind:string,ref:string,at:bigint,tokens:bigint>>")


def digest(turns: DataFrame) -> DataFrame:
    """What each conversation's output reads back as, in one pass over its turns in order.

    Returns ``conv_id``, ``n_turns``, ``turns_sha256``, ``loss_chars``, ``loss_sha256``, ``formatted_chars``, ``n_attachments`` and
    ``attachment_tokens``.  Turns stand by ``turn`` (null first), and equal ones by their output; an empty table gives none.  A conversation of any number of turns passes
    through its task in batches: only running digests are held.  Rows without a conversation are one conversation.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "attachment_tokens"]

    class Running:
        def __init__(self, conv) -> None:
            self.conv, self.turns, self.loss, self.chars, self.attached, self.tokens = conv, 0, 0, 0, 0, 0
            self.all, self.lost = hashlib.sha256(), hashlib.sha256()

        def add(self, formatted: str, mask: list[list[int]], attachments: list[int]) -> None:
            for role, text in read_turns(formatted):
                self.turns += 1
                self.all.update(f"{role}\n{text}\n".encode())
            for a, b in mask:
                text = unescape(formatted[a:b])
                self.loss += len(text)
                self.lost.update(text.encode())
            self.chars += len(formatted)
            self.attached += len(attachments)
            self.tokens += sum(attachments)

        def row(self) -> tuple:
            return self.conv, self.turns, self.all.hexdigest(), self.loss, self.lost.hexdigest(), self.chars, self.attached, self.tokens

    def run(batches):
        now = None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        for b in batches:
            done = []
            for conv, formatted, mask, tokens in zip(*[b.column(c).to_pylist() for c in ("conv_id", "formatted", "mask", "tokens")], strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now.row())
                    now = Running(conv)
                now.add(formatted, mask, tokens)
            yield batch_of(done)
        if now is not None:
            yield batch_of([now.row()])

    # Not coalesced by size: a conversation's rows must stay in one task, and in order.
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    ordered = ordered.select("conv_id", "formatted", "mask", F.col("attachments.tokens").alias("tokens"))
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, attachment_tokens long")
