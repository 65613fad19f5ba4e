"""Chat formatting by assembling tokens.

Every text is encoded on its own and control tokens are spliced in as reserved ids, so that no text can
produce one. The loss mask comes from prefix sums over segment lengths. For the written form, control
strings that occur in a text are escaped: one backslash more behind their first character than the text
had there, one less on the way back.

Template: ``<s>``, then per turn ``[INST]text[/INST]`` (user), ``[OUT]text</s>`` (assistant),
``<<SYS>>text<</SYS>>`` (system) or ``[ROLE]name[SEP]text[/ROLE]`` (any other role).

Scale: texts are encoded where they are read; only then are turns brought together by conversation,
sorted, and assembled as a stream, one conversation in memory.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .piece_codec import read_ranks
from .shared import partitions

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[SEP]", "[/ROLE]")
FRAMES = {"user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
_ANY = re.compile("|".join(rf"{re.escape(c[0])}\\*{re.escape(c[1:])}" for c in CONTROL))


def escape(text: str) -> str:
    return _ANY.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ANY.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


class Template:
    """A tiktoken vocabulary with the control strings on the ids behind it."""

    def __init__(self, vocabulary: str, pattern: str):
        import tiktoken

        ranks = read_ranks(vocabulary)
        self.plain = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        first = max(ranks.values()) + 1
        self.id_of = {c: first + i for i, c in enumerate(CONTROL)}
        self.string_of = {i: c for c, i in self.id_of.items()}
        self.first = first

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.plain.encode_ordinary(escape(text)), dtype="<u4")

    def decode(self, ids: np.ndarray) -> str:
        return self.plain.decode_bytes(ids.tolist()).decode("utf-8")

    def assemble(self, turns: list[tuple[str, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and loss mask of (role, ids of the role's name, ids of the text)."""
        segments, counted = [self._one("<s>")], [False]
        for role, name, body in turns:
            if role in FRAMES:
                a, b = FRAMES[role]
                segments += [self._one(a), body, self._one(b)]
                counted += [False, role == "assistant", False]
            else:
                segments += [self._one("[ROLE]"), name, self._one("[SEP]"), body, self._one("[/ROLE]")]
                counted += [False] * 5
        ends = np.cumsum([len(s) for s in segments])
        step = np.zeros(ends[-1] + 1, np.int32)
        for end, s, c in zip(ends, segments, counted, strict=True):
            if c:
                step[end - len(s)] += 1
                step[end] -= 1
        return np.concatenate(segments), np.cumsum(step[:-1]).astype(np.uint8)

    def _one(self, control: str) -> np.ndarray:
        return np.array([self.id_of[control]], dtype="<u4")

    def render(self, ids: np.ndarray) -> str:
        out = []
        for kind, part in self._parts(ids):
            out.append(part if kind else self.decode(part))
        return "".join(out)

    def _parts(self, ids: np.ndarray):
        """(True, control string) and (False, ids of a text), in order."""
        at = 0
        for i in np.flatnonzero(ids >= self.first):
            if i > at:
                yield False, ids[at:i]
            yield True, self.string_of[int(ids[i])]
            at = i + 1
        if at < len(ids):
            yield False, ids[at:]

    def turns(self, ids: np.ndarray) -> list[tuple[str, str]]:
        """Roles and texts, read back from the ids."""
        roles = {a: r for r, (a, _) in FRAMES.items()}
        closing = {b for _, b in FRAMES.values()} | {"[/ROLE]"}
        out, role, text, name = [], None, "", ""
        for control, part in self._parts(ids):
            if not control:
                text = unescape(self.decode(part))
            elif part in roles:
                role, text = roles[part], ""
            elif part == "[ROLE]":
                text = ""
            elif part == "[SEP]":
                name, role, text = text, None, ""
            elif part in closing:
                out.append((name if part == "[/ROLE]" else role, text))
                text = ""
        return out

    def under_mask(self, ids: np.ndarray, mask: np.ndarray) -> str:
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]]).astype(np.int8)))
        return "".join(unescape(self.decode(ids[a:b])) for a, b in zip(edges[::2], edges[1::2], strict=True))


_SHARED: dict[tuple[str, str], Template] = {}


def template_of(vocabulary: str, pattern: str) -> Template:
    """One template a worker process, vocabulary and pattern, kept from task to task."""
    if (vocabulary, pattern) not in _SHARED:
        _SHARED[vocabulary, pattern] = Template(vocabulary, pattern)
    return _SHARED[vocabulary, pattern]


def format_conversations(turns: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``conv_id, n_turns, ids binary (unsigned 32-bit), loss_mask binary (a byte an id), formatted``.

    ``turns``: conv_id, turn, role, text; more columns are ignored. Turns are taken in order of turn
    (nulls first), equal ones by role and by the ids of the text, repeated rows kept. A null role or text is empty; a
    row without a conv_id belongs to no other and is a conversation of its own. An empty table gives no rows. A conversation
    is one row of the result, so it must fit in a task's memory; texts are encoded before that, wherever they lie.
    """

    def encode(batches):
        template = template_of(vocabulary, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                roles = [r or "" for r in part.column(2).to_pylist()]
                names = [b"" if r in FRAMES else template.encode(r).tobytes() for r in roles]
                texts = part.column(3).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(roles, pa.string()), pa.array(names, pa.binary()), pa.array([template.encode(t or "").tobytes() for t in texts], pa.binary())],
                    names=["conv_id", "turn", "role", "name", "body"],
                )

    def assemble(batches):
        template = template_of(vocabulary, pattern)
        current, held, started = None, [], False

        def made():
            ids, mask = template.assemble(held)
            return current, len(held), ids.tobytes(), mask.tobytes(), template.render(ids)

        def batch_of(rows):
            types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["conv_id", "n_turns", "ids", "loss_mask", "formatted"])

        out = []
        for batch in batches:
            for conv, role, name, body in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if started and (conv is None or conv != current):
                    out.append(made())
                    held = []
                    if len(out) >= 256:
                        yield batch_of(out)
                        out = []
                current, started = conv, True
                held.append((role, np.frombuffer(name, "<u4"), np.frombuffer(body, "<u4")))
        if started:
            out.append(made())
        if out:
            yield batch_of(out)

    rows = turns.select(*[F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))])
    encoded = rows.mapInArrow(encode, "conv_id long, turn long, role string, name binary, body binary")
    lone = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "body"))  # rows without a conversation need not meet
    dealt = encoded.repartition(partitions(turns.sparkSession), "conv_id", lone).sortWithinPartitions("conv_id", "turn", "role", "body")
    return dealt.mapInArrow(assemble, "conv_id long, n_turns long, ids binary, loss_mask binary, formatted string")


def read_conversations(formatted: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Turns and loss text from the output: ``conv_id, turns array<struct<role, text>>, loss_text, formatted``.

    A row for each row of ``formatted``, null and repeated conv_ids included, and none for an empty table; more columns are ignored. Null ids
    or a null mask read as no turns and no loss text.
    """
    schema = "conv_id long, turns array<struct<role string, text string>>, loss_text string, formatted string"
    turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches):
        template = template_of(vocabulary, pattern)
        for batch in batches:
            ids = [np.frombuffer(x or b"", "<u4") for x in batch.column(1).to_pylist()]
            masks = [np.frombuffer(x, np.uint8) if x is not None else np.zeros(len(i), np.uint8) for x, i in zip(batch.column(2).to_pylist(), ids, strict=True)]
            for at in range(0, len(ids), 256):
                here = slice(at, at + 256)
                turns = [[{"role": r, "text": t} for r, t in template.turns(x)] for x in ids[here]]
                loss = [template.under_mask(x, m) for x, m in zip(ids[here], masks[here], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), pa.array(turns, turn), pa.array(loss, pa.string()), batch.column(3).slice(at, 256)], names=["conv_id", "turns", "loss_text", "formatted"])

    return formatted.select("conv_id", "ids", "loss_mask", "formatted").mapInArrow(run, schema)
