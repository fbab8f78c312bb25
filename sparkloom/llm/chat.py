"""Chat formatting by token-level assembly.

Each turn becomes  START role SEP text END  where START, SEP and END are reserved ids above the vocabulary. Role and text are
encoded apart from each other and from the template, so no merge crosses a border, and the loss mask follows from prefix sums of
the segment lengths. In print the reserved ids show as control strings; the same strings inside a role or text are escaped with a
backslash, and a backslash with another, and in a role the separator too, so both the ids and the printed form can be read back.

The vocabulary is a file of the driver's, whose ranks are broadcast to the workers. A long text is encoded in pieces of about PIECE
characters, cut only before a single space between a letter or digit and another: there the splitting pattern always has a border, so
the ids are those of the whole text. A text without such a place is encoded as one.

Defined cases: a null role or text counts as empty; rows of equal conversation and turn are all kept, ordered by role and then by a
hash of the text; null turns come first; rows with a null conversation form one conversation; an empty table gives an empty one;
columns other than the four named are ignored; texts of any length are encoded whole.

No conversation is ever held as a whole: rows are encoded where they lie, dealt out by conversation, sorted within the partition
(which spills), and folded as a stream; each turn is one row of the output.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published splitting pattern of the vocabulary, and the ids of the template, which follow its 50,256 ids.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
START, SEP, END = 50256, 50257, 50258
SHOWN = {START: "### ", SEP: ": ", END: " </turn>\n"}
_CONTROL = re.compile(r"\\|#(?=##)|<(?=/turn>)")
_CONTROL_ROLE = re.compile(r"\\|#(?=##)|<(?=/turn>)|:(?= )")
_ESCAPED = re.compile(r"\\(.)", re.S)
_BORDER = re.compile(r"(?<=[^\W_]) (?=[^\W_])")
PIECE = 1 << 16

FORMATTED = "conv_id long, seq long, ids array<int>, loss_mask array<byte>, token_start long, char_start long, chars long"


def escape(text: str, role: bool = False) -> str:
    """Puts a backslash before each backslash and before the first sign of each control string."""
    return (_CONTROL_ROLE if role else _CONTROL).sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


_coders: dict[bytes, object] = {}


def ranks(vocabulary: str) -> bytes:
    with open(vocabulary, "rb") as f:
        return f.read()


def coder(ranks: bytes):
    """The tokenizer of a rank file's contents, made once in each process."""
    if ranks not in _coders:
        import base64

        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _coders[ranks] = tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _coders[ranks]


def pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PIECE:
        m = _BORDER.search(text, at + PIECE)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encode(text: str, enc) -> list[int]:
    return enc.encode_ordinary(text) if len(text) <= PIECE else [i for p in pieces(text) for i in enc.encode_ordinary(p)]


def _encoded(ref):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = coder(ref.value)
        for b in batches:
            role = [escape(x or "", True) for x in b.column("role").to_pylist()]
            text = [escape(x or "") for x in b.column("text").to_pylist()]
            ids = pa.list_(pa.int32())
            known = {r: encode(r, enc) for r in set(role)}
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), b.column("turn"), b.column("role"), b.column("tie"), pa.array([known[r] for r in role], ids), pa.array([encode(t, enc) for t in text], ids), pa.array([len(r) + len(t) for r, t in zip(role, text, strict=True)], pa.int64())],
                names=["conv_id", "turn", "role", "tie", "role_ids", "text_ids", "chars"],
            )

    return run


def splice(role_ids: np.ndarray, text_ids: np.ndarray, trained: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a turn and its loss mask. Segment starts are prefix sums of the lengths; the mask is the prefix sum of +1 at the start of a trained segment and -1 at its end."""
    starts = np.cumsum([0, 1, len(role_ids), 1, len(text_ids), 1])
    ids = np.empty(starts[-1], np.int32)
    ids[0], ids[starts[1] : starts[2]], ids[starts[2]], ids[starts[3] : starts[4]], ids[starts[4]] = START, role_ids, SEP, text_ids, END
    step = np.zeros(starts[-1] + 1, np.int8)
    if trained:
        step[starts[3]] += 1
        step[starts[4]] -= 1
    return ids, np.cumsum(step[:-1], dtype=np.int8)


def _assembled(trained_roles: frozenset[str]):
    fixed = sum(map(len, SHOWN.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seq, tokens, chars = object(), 0, 0, 0
        for b in batches:
            conv, role = b.column("conv_id").to_pylist(), b.column("role").to_pylist()
            lengths = b.column("chars").to_pylist()
            rows = []
            for i in range(b.num_rows):
                if conv[i] != last:
                    last, seq, tokens, chars = conv[i], 0, 0, 0
                ids, mask = splice(b.column("role_ids")[i].values.to_numpy(), b.column("text_ids")[i].values.to_numpy(), role[i] in trained_roles)
                n = lengths[i] + fixed
                rows.append((conv[i], seq, ids, mask, tokens, chars, n))
                seq, tokens, chars = seq + 1, tokens + len(ids), chars + n
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int8()), pa.int64(), pa.int64(), pa.int64()]
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv_id", "seq", "ids", "loss_mask", "token_start", "char_start", "chars"])

    return run


def format_chats(turns: DataFrame, vocabulary: str = VOCABULARY, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per turn, in order within each partition: ids, loss mask, and where the turn starts in its conversation in tokens and printed characters."""
    ship(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ref = turns.sparkSession.sparkContext.broadcast(ranks(vocabulary))
    ids = rows.mapInArrow(_encoded(ref), "conv_id long, turn long, role string, tie long, role_ids array<int>, text_ids array<int>, chars long")
    dealt = ids.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "tie")
    return dealt.mapInArrow(_assembled(frozenset(trained_roles)), FORMATTED)


def parse_turn(ids: np.ndarray, mask: np.ndarray, enc) -> tuple[str, str, str, str]:
    """Role, text, text under the mask, and printed form of a turn's ids."""
    marks = np.flatnonzero(ids >= START)
    if len(marks) != 3 or ids[marks].tolist() != [START, SEP, END]:
        raise ValueError("a turn is START role SEP text END")
    part = lambda a, z: enc.decode_bytes(ids[a:z].tolist()).decode("utf-8")
    role, text = part(marks[0] + 1, marks[1]), part(marks[1] + 1, marks[2])
    loss = enc.decode_bytes(ids[mask.astype(bool) & (ids < START)].tolist()).decode("utf-8")
    return unescape(role), unescape(text), unescape(loss), f"{SHOWN[START]}{role}{SHOWN[SEP]}{text}{SHOWN[END]}"


def _digests(ref):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, last, state = coder(ref.value), None, None

        def rows(done):
            n, turns, loss_chars, loss, chars, tokens = done[1]
            return (done[0], n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, tokens)

        out: list[tuple] = []
        for b in batches:
            for conv, ids, mask in zip(b.column("conv_id").to_pylist(), b.column("ids"), b.column("loss_mask"), strict=True):
                if state is None or conv != last:
                    if state is not None:
                        out.append(rows((last, state)))
                    last, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                ids = ids.values.to_numpy()
                role, text, loss, shown = parse_turn(ids, mask.values.to_numpy(), enc)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(shown)
                state[5] += len(ids)
            yield _table(out)
            out = []
        if state is not None:
            yield _table([rows((last, state))])

    return run


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"])


def digest_chats(formatted: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Reads format_chats() output back: per conversation its turns, texts under the mask and printed length, as counts and digests. Expects that function's partitioning and order."""
    ref = formatted.sparkSession.sparkContext.broadcast(ranks(vocabulary))
    return formatted.mapInArrow(_digests(ref), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")


def print_chat(turns: list[tuple[str, str]]) -> str:
    return "".join(f"{SHOWN[START]}{escape(r, True)}{SHOWN[SEP]}{escape(t)}{SHOWN[END]}" for r, t in turns)


def read_chat(shown: str) -> list[tuple[str, str]]:
    """Reads print_chat() output back."""
    mark = re.compile(r"\\.|### |: | </turn>\n", re.S)
    out, at, role, begun = [], 0, None, 0
    for m in mark.finditer(shown):
        s = m.group()
        if s == SHOWN[START] and role is None and m.start() == at:
            begun = m.end()
        elif s == SHOWN[SEP] and role is None:
            role, begun = unescape(shown[begun : m.start()]), m.end()
        elif s == SHOWN[END] and role is not None:
            out.append((role, unescape(shown[begun : m.start()])))
            role, at = None, m.end()
    return out
