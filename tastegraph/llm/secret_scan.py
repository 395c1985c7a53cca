"""Credentials in texts: fixed patterns, and formats learned from what they find.

The strings found by the patterns in all documents are labelled credentials, of
which a bounded number is learned from. For each kind a prefix tree of their
character classes is reduced by merging states whose statistics agree, which
leaves a probabilistic automaton of the format. Every other token of a text that is
as long as the shortest value of an assignment is scored: by how likely an automaton
is to write it, against ordinary text and the share of credentials among tokens.
"""

import hashlib
import math
import re
from collections import Counter, deque
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegraph.llm.common import Memo, batches_of, text_bytes
from tastegraph.session import materialise

#: The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "format")

#: Decisions that a task keeps, by the classes of a token.
KEPT_DECISIONS = 200_000

#: The shortest value of an assignment, and so the shortest token that is scored.
SHORTEST = 6

@dataclass(frozen=True)
class Settings:
    """Bounds on what is learned from, and the merge and acceptance tests.

    All texts are searched and the ``strings`` distinct strings of a kind with the
    least hashes used, of longer ones the first ``chars`` characters. ``alpha`` is
    the error of the test that two states differ. A token is accepted when its mean
    log-likelihood per character is at least the lowest of the labelled strings less
    ``slack``, and its likelihood exceeds that of ordinary text by more than ordinary
    tokens outnumber credentials.
    """

    strings: int = 400
    chars: int = 4_000
    alpha: float = 0.05
    slack: float = 0.25


def _assignments(text: str) -> list[re.Match]:
    """Matches of the assignment pattern; texts without any of its names are not searched."""
    low = text.lower()
    if not any(name in low for name in ("passw", "secret", "token", "apikey", "api_key")):
        return []
    return [m for m in ASSIGN.finditer(text) if len(m[2]) >= SHORTEST]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, in code points."""
    found = [(m.start(), 0, m.end()) for m in _assignments(text)]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def labelled(text: str) -> list[tuple[str, str]]:
    """(kind, credential) of the base matches: for assignments the value alone."""
    found = [("assign", m[2]) for m in _assignments(text)]
    found += [("access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return found + [("hex", m[0]) for m in HEX.finditer(text)]


_CLASSES = str.maketrans(
    {c: "d" for c in "0123456789"}
    | {c: "x" for c in "abcdef"}
    | {chr(c): "l" for c in range(ord("g"), ord("z") + 1)}
    | {chr(c): "U" for c in range(ord("A"), ord("Z") + 1)}
)
#: Digits, hex letters, other small letters, capitals, and the signs + / _ . = -
_SYMBOLS = 10
#: A token that is scored, written in classes. Texts have no other way to these letters:
#: each letter and digit has a class.
_TOKEN = re.compile(r"[dxlU+/_.=-]{%d,}" % SHORTEST)


@dataclass
class State:
    """Counts of what follows in the strings that reach this state."""

    ends: int = 0
    through: Counter = field(default_factory=Counter)
    next: dict = field(default_factory=dict)

    @property
    def total(self) -> int:
        return self.ends + self.through.total()


class FormatAutomaton:
    """A probabilistic automaton inferred from labelled strings by state merging."""

    def __init__(self, strings: list[str], alpha: float):
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.states = [State()]
        for s in strings:
            at = 0
            for c in s.translate(_CLASSES):
                self.states[at].through[c] += 1
                if c not in self.states[at].next:
                    self.states[at].next[c] = len(self.states)
                    self.states.append(State())
                at = self.states[at].next[c]
            self.states[at].ends += 1
        self._merge_states()
        self.least = min(map(self.score, strings), default=0.0)

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        """Hoeffding's bound on the difference of two frequencies."""
        return abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        open_ = [(a, b)]
        while open_:
            i, j = open_.pop()
            p, q = self.states[i], self.states[j]
            m, n = p.total, q.total
            if not m or not n:
                continue
            if self._differ(p.ends, m, q.ends, n):
                return False
            for c in p.through.keys() | q.through.keys():
                if self._differ(p.through[c], m, q.through[c], n):
                    return False
                if c in p.next and c in q.next:
                    open_.append((p.next[c], q.next[c]))
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Add a tree's counts to the states of the automaton that mirror it."""
        open_ = [(into, tree)]
        while open_:
            i, j = open_.pop()
            p, q = self.states[i], self.states[j]
            p.ends += q.ends
            p.through.update(q.through)
            for c, child in q.next.items():
                if c in p.next:
                    open_.append((p.next[c], child))
                else:
                    p.next[c] = child

    def _merge_states(self) -> None:
        """Breadth first: each tree state joins a kept state that it agrees with."""
        kept, fringe = [0], deque((0, c) for c in sorted(self.states[0].next))
        while fringe:
            parent, c = fringe.popleft()
            child = self.states[parent].next[c]
            if child in kept:
                continue
            twin = next((k for k in kept if self._compatible(k, child)), None)
            if twin is None:
                kept.append(child)
                fringe.extend((child, x) for x in sorted(self.states[child].next))
            else:
                self.states[parent].next[c] = twin
                self._fold(twin, child)
                fringe.extend(
                    (k, x) for k in kept for x in sorted(self.states[k].next) if self.states[k].next[x] not in kept
                )

    def score(self, s: str) -> float:
        """Mean log-likelihood per character, the end included."""
        return self.score_classes(s.translate(_CLASSES))

    def score_classes(self, s: str) -> float:
        at, total = 0, 0.0
        for c in s:
            state = self.states[at]
            total += math.log((state.through[c] + 0.01) / (state.total + 0.01 * (_SYMBOLS + 1)))
            if c not in state.next:
                return -math.inf
            at = state.next[c]
        state = self.states[at]
        total += math.log((state.ends + 0.01) / (state.total + 0.01 * (_SYMBOLS + 1)))
        return total / (len(s) + 1)


@dataclass
class Formats:
    """The learned automata, and what ordinary text looks like.

    ``background`` counts the classes of all characters, ``tokens`` the tokens that
    are scored and ``credentials`` the labelled strings among them.
    """

    automata: list[FormatAutomaton]
    background: Counter
    slack: float
    tokens: int = 0
    credentials: int = 0

    def accepts(self, token: str) -> bool:
        return self.accepts_classes(token.translate(_CLASSES))

    def accepts_classes(self, token: str) -> bool:
        """Whether a token of these classes fits a format; nothing else of it matters."""
        total = self.background.total() + _SYMBOLS
        ends = math.log((self.tokens + 1) / (total + self.tokens + 1))
        plain = ends + sum(math.log((self.background[c] + 1) / total) for c in token)
        odds = math.log((self.tokens + 1) / (self.credentials + 1))
        scores = ((a.score_classes(token), a.least) for a in self.automata)
        return any(s >= least - self.slack and s * (len(token) + 1) - plain > odds for s, least in scores)


def learn_formats(docs: DataFrame, settings: Settings = Settings(), text_col: str = "text") -> Formats:
    """Automata for each kind, from the credentials and class counts of all texts.

    A task sends the strings of a kind with the least hashes, so what is shuffled
    and what reaches the driver is bounded, and the choice is that of all texts
    whatever the order of rows.
    """
    schema = pa.schema([("kind", pa.string()), ("value", pa.string()), ("h", pa.int64()), ("n", pa.int64())])

    def run(batches):
        strings: dict[str, dict[str, int]] = {kind: {} for kind in KINDS[:3]}
        background: Counter[str] = Counter()
        for batch in batches:
            for body in batch.column(0).to_pylist():
                text = body.decode()
                for kind, value in labelled(text):
                    background["credentials"] += 1
                    value = value[: settings.chars]
                    strings[kind][value] = hash_of(value) - (1 << 63)
                    if len(strings[kind]) >= 4 * settings.strings:
                        strings[kind] = dict(_least(strings[kind], settings.strings))
                classes = text.translate(_CLASSES)
                background.update({c: classes.count(c) for c in "dxlU+/_.=-"})
                background["tokens"] += len(_TOKEN.findall(classes))
        rows = [(kind, v, h, 0) for kind, held in strings.items() for v, h in _least(held, settings.strings)]
        rows += [("background", c, 0, count) for c, count in background.items()]
        yield from batches_of(iter(rows), schema)

    found = materialise(
        docs.select(text_bytes(text_col).alias("body"))
        .mapInArrow(run, "kind string, value string, h long, n long")
        .groupBy("kind", "value", "h")
        .agg(F.sum("n").alias("n")),
        "credentials",
    )
    automata = []
    for kind in KINDS[:3]:
        chosen = found.where(F.col("kind") == kind).orderBy("h", "value").limit(settings.strings).collect()
        if chosen:
            automata.append(FormatAutomaton([r.value for r in chosen], settings.alpha))
    background = Counter({r.value: r.n for r in found.where("kind = 'background'").collect()})
    tokens, credentials = background.pop("tokens", 0), background.pop("credentials", 0)
    return Formats(automata, background, settings.slack, tokens, credentials)


def _least(strings: dict[str, int], n: int) -> list[tuple[str, int]]:
    """The ``n`` strings with the least hashes."""
    return sorted(strings.items(), key=lambda x: (x[1], x[0]))[:n]


def hash_of(value: str) -> int:
    return xxhash.xxh64_intdigest(value)


def all_spans(text: str, formats: Formats, decided: dict[str, bool] | None = None) -> tuple[list, list]:
    """The base spans, and with them the tokens that fit a learned format.

    ``decided`` keeps the decisions by a token's classes.
    """
    base = base_spans(text)
    if decided is None:
        decided = Memo(formats.accepts_classes, KEPT_DECISIONS)
    added = [
        (m.start(), 3, m.end())
        for m in _TOKEN.finditer(text.translate(_CLASSES))
        if decided[m[0]] and not any(s < m.end() and m.start() < e for s, _, e in base)
    ]
    return base, sorted(base + added)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(
    docs: DataFrame,
    formats: Formats | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_format`` for every row.

    Positions count code points, ends are exclusive. A null or empty text has no
    spans (and the digest of nothing); repeated rows are scanned each; an empty
    table gives an empty result; other columns are not read.
    """
    formats = formats or learn_formats(docs, text_col=text_col)
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format"]

    def run(batches):
        decided = Memo(formats.accepts_classes, KEPT_DECISIONS)
        for batch in batches:
            rows = []
            for body in batch.column(1).to_pylist():
                base, spans = all_spans(body.decode(), formats, decided)
                kinds = Counter(k for _, k, _ in spans)
                digest = hashlib.sha256(written(base).encode()).hexdigest()
                rows.append((kinds[0], kinds[1], kinds[2], digest, written(spans), kinds[3]))
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            columns = zip(*rows, strict=True) if rows else [()] * 6
            arrays = [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]
            yield pa.record_batch([batch.column(0), *arrays], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("body"))
    return rows.mapInArrow(
        run,
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long",
    )
