"""Secret scan: patterns for well-known kinds, and a token-efficiency test for random strings.

Three fixed patterns give the base spans. Beyond them, every long run of key-like characters is cut into tokens of a
tiktoken vocabulary. Words and identifiers need few tokens; random strings fall apart into tokens of one or two
characters. A run with a low number of characters per token is a span of kind ``token``, unless it has the form of a
digest (hexadecimal of a usual length) or an identifier (UUID, words joined by punctuation, one word, one number). Of a
run that meets base spans, the parts outside them are tested; in a run that is not random as a whole, each piece between
joints is, and each window of tokens inside a long piece, so words around a secret don't hide it.

A null or empty text has no spans. Positions are code points, ends exclusive. Repeated rows and ids are scanned one by
one; extra columns stay; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from itertools import accumulate

import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotalens.llm.common import append_columns, by_value, field, Shared

by_value(__name__)

# The base patterns, with letters of either case in the first one's keywords only (its values have both).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: Order of kinds where spans start together.
KINDS = ("assign", "access", "hex", "token")

#: A run worth a token test, the digests' lengths, and identifiers.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PIECE = re.compile(r"[A-Za-z0-9+]{20,}")
WINDOW = 20
DIGESTS = (32, 40, 56, 64, 96, 128)
IDENTIFIER = re.compile(
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"  # UUID
    r"|(?:[A-Z]?[a-z]++|[A-Z]++|[0-9]++)(?:[-_/+=]++(?:[A-Z]?[a-z]++|[A-Z]++|[0-9]++))*+[-_/+=]*+"  # words and numbers with joints
    r"|[A-Z]?[a-z]{2,}([A-Z][a-z]{2,})*[0-9]{0,4}"  # camel case
    r"|[-_/+=]+"
)
HEXADECIMAL = re.compile(r"[0-9a-fA-F]+")

#: Cut of words before tokens are formed: the vocabulary's own pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters per token below which a run counts as random.
RATIO = 2.2

SPAN = "struct<kind: string, start: int, stop: int, value: int>"


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the secret itself)."""
    spans = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        spans += [("assign", *m.span(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    for run in RUN.finditer(text):  # the other kinds stand inside such runs
        spans += [("access", *m.span(), m.start()) for m in ACCESS.finditer(text, *run.span()) if len(m[0]) >= LEAST["access"]]
        spans += [("hex", *m.span(), m.start()) for m in HEX.finditer(text, *run.span()) if len(m[0]) >= LEAST["hex"]]
    return spans


def plain(piece: str) -> bool:
    """A digest or an identifier."""
    bare = piece.rstrip("=")
    return bool(HEXADECIMAL.fullmatch(bare) and len(bare) in DIGESTS or IDENTIFIER.fullmatch(piece))


def random_run(run: str, encoding: tiktoken.Encoding, ratio: float) -> bool:
    return not plain(run) and len(run) < ratio * len(encoding.encode_ordinary(run))


def random_parts(run: str, encoding: tiktoken.Encoding, ratio: float) -> list[tuple[int, int]]:
    """The whole run if it is random, else its random pieces between joints, else its random windows of ``WINDOW`` characters."""
    if random_run(run, encoding, ratio):
        return [(0, len(run))]
    if plain(run):
        return []
    out = []
    for m in PIECE.finditer(run):
        if random_run(m[0], encoding, ratio):
            out.append(m.span())
        elif not plain(m[0]) and len(m[0]) > WINDOW:
            out += [(m.start() + a, m.start() + b) for a, b in random_windows(m[0], encoding, ratio)]
    return out


def random_windows(piece: str, encoding: tiktoken.Encoding, ratio: float) -> list[tuple[int, int]]:
    """Unions of the windows of whole tokens, ``WINDOW`` characters or just above, that are random."""
    edges = list(accumulate((len(encoding.decode_single_token_bytes(t)) for t in encoding.encode_ordinary(piece)), initial=0))
    out: list[tuple[int, int]] = []
    last = 0
    for first, a in enumerate(edges):
        while last < len(edges) and edges[last] - a < WINDOW:
            last += 1
        if last == len(edges):
            break
        b = edges[last]
        if b - a < ratio * (last - first) and not plain(piece[a:b]):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
    return out


def find_spans(text: str | None, encoding: tiktoken.Encoding, ratio: float = RATIO) -> list[tuple[str, int, int, int]]:
    if not text:
        return []
    spans = base_spans(text)
    taken = sorted(s[1:3] for s in spans)
    next_, reach = 0, 0
    for m in RUN.finditer(text):
        at, free = max(m.start(), min(reach, m.end())), []
        while next_ < len(taken) and taken[next_][0] < m.end():
            free.append((at, taken[next_][0]))
            reach = max(reach, taken[next_][1])
            at = max(at, min(reach, m.end()))
            next_ += 1
        for a, b in [*free, (at, m.end())]:  # what no base span covers
            if b - a >= WINDOW:
                spans += [("token", a + x, a + y, a + x) for x, y in random_parts(text[a:b], encoding, ratio)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


class _Shared:
    """The vocabulary in a broadcast; the encoder is made once per worker."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.made = ranks, None

    def encoding(self) -> tiktoken.Encoding:
        if self.made is None:
            self.made = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        return self.made


def scan_secrets(
    df: DataFrame, vocabulary_path: str, text: str = "text", ratio: float = RATIO, keep: list[str] | None = None,
) -> DataFrame:
    """Add ``secret_spans``: an array of (kind, start, stop, value), sorted by start and kind."""
    shared = Shared(df, _Shared(load_ranks(vocabulary_path)))

    def start():
        encoding = shared.value.encoding()
        names = ("kind", "start", "stop", "value")
        return lambda texts: [[[dict(zip(names, s)) for s in find_spans(t, encoding, ratio)] for t in texts]]

    return append_columns(df, text, [field("secret_spans", f"array<{SPAN}>")], start, keep)


def count_kind(kind: str) -> Column:
    return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")


def spans_text(kinds: tuple[str, ...] = KINDS) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    held = F.filter("secret_spans", lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(held, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(df: DataFrame, vocabulary_path: str, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``df`` with every secret's value replaced by ``mark``. Rows without a span stay as they are, null texts too."""
    shared = Shared(df, _Shared(load_ranks(vocabulary_path)))

    def start():
        encoding = shared.value.encoding()

        def clean(value):
            spans = find_spans(value, encoding)
            if not spans:
                return value
            out, at = [], 0
            for first, stop in sorted((s[3], s[2]) for s in spans):
                if first >= at:
                    out += [value[at:first], mark]
                at = max(at, stop)
            return "".join([*out, value[at:]])

        return lambda texts: [[clean(t) for t in texts]]

    order = df.columns
    return append_columns(df, text, [field(text, "string")], start).select(*order)
