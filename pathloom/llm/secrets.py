"""Secrets in texts: fixed patterns, and password guess-cost dynamic programming on values in credential contexts.

A value's guess cost (log10 of guesses) is that of the cheapest way to cut it into words of a list, dates and years,
repeats, keyboard walks and sequences, and brute-force spans; each further segment costs a factor more, as guessers
must try its place too. Values that a guesser needs many guesses for are secrets, placeholders and plain words are not.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from math import inf, log10

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm._common import Shipped, map_rows, mapped

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are whole: the same as runs of any length, the short ones dropped
KINDS = ("assign", "access", "hex", "guess")
#: A name that announces a credential, and its value: quoted (over lines, too), a PEM block, or up to white space, as also
#: after a quote that nothing closes.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|auth(?:orization)?|bearer|credentials?)["']?\x20*(?::|=>|=)\x20*(?:bearer\x20+)?(?:"([^"]+)"|'([^']+)'|(-----BEGIN\x20[^\n-]+-----(?:[^-]|-(?!----))*-----END\x20[^\n-]+-----)|["']?([^\s"'<>,;(){}]{6,}))""",
    re.ASCII | re.IGNORECASE,
)
CALLS = re.compile("pass|pwd|secret|token|key|auth|bearer|credential", re.ASCII | re.IGNORECASE).search
#: log10 of the guesses from which a value is a secret, and of the factor that each segment after the first costs.
LEAST, FURTHER = 8.0, 0.5
WORDS = (
    "password passwd pass secret token key api admin root user login test example sample demo changeme change placeholder your my the is not "
    "welcome letmein master monkey dragon shadow sunshine princess football baseball iloveyou trustno superman batman hello guest default "
    "none null true false undefined value string required optional here xxxx todo redacted hidden masked dummy fake foobar foo bar baz qux "
    "account access auth private public client server data database config env dev prod staging local host name email phone address number "
    "and for with that this from have are was will can must should code text word field form type invalid expired missing reset forgot "
    "correct horse battery staple january february march april may june july august september october november december monday tuesday "
    "wednesday thursday friday saturday sunday spring summer autumn winter love money apple google amazon computer internet"
).split()
PLAIN = str.maketrans("430157@$!", "aeolstasi")
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "qazwsxedcrfvtgbyhnujmik", "abcdefghijklmnopqrstuvwxyz", "0123456789")
NEXT = {(a, b) for row in ROWS for a, b in (*zip(row, row[1:]), *zip(row[::-1], row[::-1][1:]))}
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)?\d\d")
DATES = range(3, 11)
#: log10 of a walk's starts and directions, and of the factor that a number of repeats or steps costs each time it doubles.
WALKS, DOUBLING = log10(len(NEXT)), log10(2)


def word_ranks(more: list[str] | None = None) -> dict[str, int]:
    """Rank (from 1) of each word: WORDS, then ``more``, the commonest first."""
    ranks: dict[str, int] = {}
    for w in [*WORDS, *(more or [])]:
        ranks.setdefault(w, len(ranks) + 1)
    return ranks


def vocabulary_words(path: str) -> list[str]:
    """Whole words of a tokenizer file with word ends, in the order of its ids: the commonest, by and large, first."""
    import json

    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    whole = [(i, w[: -len("</w>")]) for w, i in vocab.items() if w.endswith("</w>")]
    return [w for _, w in sorted(whole) if len(w) >= 3 and w.isascii() and w.isalpha()]


def _alphabet(c: str) -> float:
    return 1.0 if c.isdigit() else 1.42 if c.isalpha() and c.isascii() else 1.52 if c.isascii() else 2.5


def _word_cost(part: str, low: str, found: str, rank: int) -> float:
    """``part`` as the word ``found``: its lower case ``low``, or that with signs read as letters."""
    mixed = part != low and not part.isupper() and not part.istitle()
    return log10(rank + 1) + (0.3 if part != low else 0) + (1.0 if mixed else 0) + (0.5 if found != low else 0)


class _Runs:
    """Cheapest ways to end with a run of ``unit`` characters ``least`` times or more, however long it goes on.

    The number of times costs DOUBLING for each power of two up to it. So for each power the least cost of the starts
    that are near enough is wanted, which a queue of the starts that may still be the least gives at once.
    """

    def __init__(self, unit: int, least: int):
        self.unit, self.least, self.start = unit, least, 0
        self.queues: dict[tuple[int, int], deque] = {}

    def ends(self, j: int, start: int, costs: list[float]) -> float:
        """``start``: where the run that ends at j begins; ``costs``: of a run's begin at each place before."""
        unit, least = self.unit, self.least
        if start != self.start:
            self.start = start
            self.queues.clear()
        new = j - unit * least
        if new < start:
            return inf
        best, power = inf, 1
        while (1 << power - 1) * unit < j - start or power == 1:
            q, add = self.queues.get((power, j % unit)), [new]
            if q is None:  # no start has been too far for the next lower power yet
                q, add = self.queues.setdefault((power, j % unit), deque()), range(start + (j - start) % unit, new + 1, unit)
            if (1 << power) >= least:
                for x in add:
                    while q and costs[q[-1]] >= costs[x]:
                        q.pop()
                    q.append(x)
                while q[0] < j - (unit << power):
                    q.popleft()
                best = min(best, costs[q[0]] + DOUBLING * power)
            power += 1
        return best


class Guesser:
    """The guess cost (log10 of guesses) of values, by the words in ``ranks``."""

    def __init__(self, ranks: dict[str, int] | None = None):
        self.ranks = ranks if ranks is not None else word_ranks()
        self.longest = max(map(len, self.ranks), default=0)

    def cost(self, value: str) -> float:
        """That of the cheapest segmentation of ``value``; 0 for an empty one.

        Exact over all segmentations, with time n log n in the value's length: words and dates have a greatest length,
        walks and repeats end anywhere.
        """
        n = len(value)
        low = value.lower()
        plain = low.translate(PLAIN)
        if len(low) != n or len(plain) != n:  # a letter whose lower case is longer
            low = plain = value
        ranks, longest = self.ranks, self.longest
        best = [0.0] + [inf] * n
        brute = inf  # the last segment is a brute-force span, which may still grow
        step = [_alphabet(c) for c in value]
        sums = [0.0]
        for x in step:
            sums.append(sums[-1] + x)
        walks, repeats = _Runs(1, 3), [_Runs(unit, 3 if unit == 1 else 2) for unit in (1, 2, 3, 4)]
        begin: list[float] = []  # cost of all that is before a segment, which itself costs a factor unless it is the first
        units: list[list[float]] = [[] for _ in repeats]
        walk, same = 0, [0] * len(repeats)
        for j in range(n + 1):
            if j:
                brute = min(brute, begin[j - 1]) + step[j - 1]
                best[j] = min(best[j], brute)
                if j > 1 and (low[j - 2], low[j - 1]) not in NEXT:
                    walk = j - 1
                best[j] = min(best[j], walks.ends(j, walk, begin) + WALKS)
                for k, runs in enumerate(repeats):
                    if j > runs.unit and value[j - 1] != value[j - 1 - runs.unit]:
                        same[k] = j - runs.unit
                    best[j] = min(best[j], runs.ends(j, same[k], units[k]))
            if j == n:
                break
            at = best[j] + (FURTHER if j else 0.0)
            begin.append(at)
            for k, runs in enumerate(repeats):
                units[k].append(at + sums[min(n, j + runs.unit)] - sums[j])
            for text in (low, plain) if plain[j : j + longest] != low[j : j + longest] else (low,):
                for e in range(j + 2, min(n, j + longest) + 1):
                    if (rank := ranks.get(text[j:e])) is not None:
                        best[e] = min(best[e], at + _word_cost(value[j:e], low[j:e], text[j:e], rank))
            if "0" <= value[j] <= "9":
                for size in DATES:
                    if j + size <= n and DATE.fullmatch(value, j, j + size):
                        best[j + size] = min(best[j + size], at + date_cost(size))
        return best[n]


def date_cost(size: int) -> float:
    """Of a date, or of a year or month of few characters."""
    return log10(119 * 365) if size > 4 else log10(119)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start, then kind as in KINDS."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] if ":" in text or "=" in text else []
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2], x[1]))]


def guess_spans(text: str, least: float = LEAST, guesser: Guesser | None = None) -> list[tuple[int, int, str]]:
    """Values of 6 or more characters in credential contexts whose guess cost is at least ``least``; nothing else decides."""
    if not (":" in text or "=" in text) or not CALLS(text):
        return []
    guesser = guesser or Guesser()
    out = []
    for m in CONTEXT.finditer(text):
        k = m.lastindex
        start, end = m.span(k)
        value = text[start:end]
        if k == 4:
            value = value.rstrip(".!?:")
            end = start + len(value)
        if len(value) >= 6 and guesser.cost(value) >= least:
            out.append((start, end, "guess"))
    return out


def all_spans(text: str, least: float = LEAST, guesser: Guesser | None = None) -> list[tuple[int, int, str]]:
    """The base spans, and the costly values of all credential contexts, those of base spans too; by start, then kind."""
    return sorted([*base_spans(text), *guess_spans(text, least, guesser)], key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def find_secrets(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text", least: float = LEAST, words: list[str] | None = None) -> DataFrame:
    """``keys`` and secrets (array of kind, start, end, value), base (how many of them come from the fixed patterns).

    Code points, end exclusive. A null text counts as empty; rows without secrets have an empty array; repeated rows
    stay repeated; an empty table gives an empty result. Only keys and text are read. ``words``: more words that guessers
    know, the commonest first; a list of bounded size, as it is sent to all tasks.
    """
    sent = Shipped(docs.sparkSession, word_ranks(words))

    def run(parts: Iterator[list]) -> Iterator[dict]:
        guesser = Guesser(sent.load())
        for texts in parts:
            yield {"secrets": [[{"kind": k, "start": a, "end": b, "value": t[a:b]} for a, b, k in all_spans(t, least, guesser)] for t in texts]}

    return map_rows(docs, list(keys), text_col, run, "secrets array<struct<kind:string,start:int,end:int,value:string>>")


def secret_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: list[str] | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each row of ``docs``, from find_secrets()."""
    found = find_secrets(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), words=words)

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", number("assign").alias("n_assign"), number("access").alias("n_access"), number("hex").alias("n_hex"),
        F.sha2(joined(F.filter("secrets", lambda s: s["kind"] != "guess")), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"),
    )


def redact(text: str, least: float = LEAST, guesser: Guesser | None = None) -> str:
    """The text with each secret's value replaced by [REDACTED]; what announces a value stays."""
    spans = []
    for a, b, kind in all_spans(text, least, guesser):
        if kind == "assign":
            a += ASSIGN.match(text, a, b).start(2) - a
        spans.append((a, b))
    out, at = [], 0
    for a, b in sorted(spans):
        if a < at:  # within or overlapping the one before
            at = max(at, b)
            continue
        out += [text[at:a], "[REDACTED]"]
        at = b
    out.append(text[at:])
    return "".join(out)


def redact_secrets(docs: DataFrame, text_col: str = "text", least: float = LEAST, words: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` with secrets redacted in ``text_col``; null texts stay null, other columns as they are, whatever
    their names; repeated rows stay repeated, an empty table stays empty."""
    sent = Shipped(docs.sparkSession, word_ranks(words))

    def begin():
        guesser = Guesser(sent.load())
        return lambda texts: [redact(t, least, guesser) for t in texts]

    return docs.withColumn(text_col, F.when(F.col(text_col).isNotNull(), mapped(F.col(text_col), begin, "string")))
