"""Operator 3: quality rules as a short-circuit cascade ordered by rejection per cost.

A rule is a predicate on one document's measurements; a document is kept if no rule rejects
it. On a sample the planner times each rule and counts what it rejects. Rules with the most
rejections per second go first, and each later rule is judged only on what the earlier ones
let pass, both in planning and in the run. The verdict doesn't depend on the order.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField

from vigilog.llm.common import extend, utf8

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
#: Word ids below this fit three times into 63 bits.
_TRIPLE_IDS = 1 << 21
_KNOWN: dict[bytes, int] = {}


class Document:
    """Measurements of one text, each made when a rule first asks for it."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.raw = utf8(text)
        self._words: list[bytes] | None = None

    @property
    def words(self) -> list[bytes]:
        if self._words is None:
            self._words = self.raw.split()      # splits bytes at exactly the contract's spaces
        return self._words

    def word_chars(self) -> int:
        return len(self.text) - (len(self.raw) - len(self.raw.translate(None, _SPACE)))

    def symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, _SYMBOLS))

    def duplicate_lines(self) -> int:
        lines = [x for x in self.raw.split(b"\n") if x.strip(_SPACE)]
        return len(lines) - len(set(lines))

    def repeated_words(self) -> int:
        """Words inside a three-word window that the text has twice or more."""
        words = self.words
        n = len(words)
        if n < 4:
            return 0
        global _KNOWN
        if len(_KNOWN) + n >= _TRIPLE_IDS:
            _KNOWN = {}
        known = _KNOWN
        get = known.setdefault
        ids = np.fromiter((get(w, len(known)) for w in words), np.int64, n)
        if len(known) >= _TRIPLE_IDS:           # one huge text: number its own pairs first
            _KNOWN = {}
            pair = np.unique(ids[:-1] << 32 | ids[1:], return_inverse=True)[1]
            key = pair[:-1] << 32 | ids[2:]
        else:
            key = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
        order = np.sort(key)
        twice = order[1:][order[1:] == order[:-1]]
        if not len(twice):
            return 0
        starts = np.isin(key, twice)
        hit = np.zeros(n, bool)
        for shift in range(3):
            hit[shift:n - 2 + shift] |= starts
        return int(hit.sum())

    def uppercase(self) -> int:
        return len(_UPPER.findall(self.text))

    def bangs(self) -> int:
        return self.raw.count(b"!!")

    def plain_words(self) -> int:
        """Words of letters alone, but for one closing punctuation mark."""
        return len(_PLAIN.findall(self.text))


_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]{2}")
_PLAIN = regex.compile(r"(?<![^ \t-\r])\p{L}+[.,;:!?]?(?![^ \t-\r])")


@dataclass(frozen=True)
class Rule:
    """`rejects` says whether a document fails; `cost` overrides the timed cost (for tests)."""

    name: str
    rejects: Callable[[Document], bool]
    cost: float | None = None


#: The thresholds of the contract's own two rules, and those of the cascade beyond it.
BASE_RULES = (
    Rule("too_short", lambda d: len(d.words) < 50),
    Rule("repeated_windows", lambda d: 100 * d.repeated_words() > 50 * len(d.words)),
)
QUALITY_RULES = BASE_RULES + (
    Rule("symbols", lambda d: 10 * d.symbols() > len(d.words)),
    Rule("shouting", lambda d: 4 * d.uppercase() > len(d.words)),
    Rule("bangs", lambda d: 20 * d.bangs() > len(d.words)),
    Rule("few_plain_words", lambda d: 2 * d.plain_words() < len(d.words)),
    Rule("duplicate_lines", lambda d: d.duplicate_lines() >= 3
         and 10 * d.duplicate_lines() > 3 * (d.raw.count(b"\n") + 1)),
)


@dataclass(frozen=True)
class Plan:
    """Rules in running order, and the sample's (cost in seconds, rejections, seen) of each."""

    rules: tuple[Rule, ...]
    measured: dict[str, tuple[float, int, int]]


def plan(texts: list[str | None], rules: tuple[Rule, ...] = QUALITY_RULES) -> Plan:
    """Order rules by rejection per cost, greedily on what the chosen ones let pass.

    Ties go to the rule that is listed first; without texts the given order stays.
    """
    left, order, measured = list(rules), [], {}
    pool = list(texts)
    while left:
        best = None
        for rule in left:
            began = time.perf_counter()
            verdicts = [rule.rejects(Document(t)) for t in pool]
            spent = time.perf_counter() - began if rule.cost is None else rule.cost * len(pool)
            rate = sum(verdicts) / max(spent, 1e-9)
            if best is None or rate > best[0]:
                best = rate, rule, verdicts, spent
        _, rule, verdicts, spent = best
        measured[rule.name] = (spent, sum(verdicts), len(pool))
        pool = [t for t, out in zip(pool, verdicts, strict=True) if not out]
        order.append(rule)
        left.remove(rule)
    return Plan(tuple(order), measured)


def plan_from(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = QUALITY_RULES,
              sample_rows: int = 256) -> Plan:
    """Plan on a bounded sample; it decides the order only, so never the result."""
    total = df.count()
    share = min(1.0, 4 * sample_rows / total) if total else 1.0
    rows = df.select(F.col(text).alias("t")).sample(share, seed=7).limit(sample_rows).collect()
    return plan([r.t for r in rows], rules)


def apply_rules(df: DataFrame, order: tuple[Rule, ...] = QUALITY_RULES, text: str = "text",
                keep: list[str] | None = None) -> DataFrame:
    """Adds the base measurements, the verdict and the first rule that rejected.

    New columns: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    base_failed, kept (boolean), rejected_by (string, null if kept). A null text has no
    words and fails. Equal texts get equal rows; no row is dropped; no shuffle. The base
    failures are known from the measurements, so the cascade runs only on the rest, and a
    rule only on what the rules before it let pass.
    """
    base = {r.name for r in BASE_RULES}
    first = [r for r in order if r.name in base]
    rest = [r for r in order if r.name not in base]

    def build():
        def work(texts: list) -> list:
            docs = [Document(t) for t in texts]
            measures = [[len(d.words) for d in docs], [d.word_chars() for d in docs],
                        [d.symbols() for d in docs], [d.duplicate_lines() for d in docs],
                        [d.repeated_words() for d in docs]]
            failed, why = [], []
            alive = []
            for i, d in enumerate(docs):
                n, repeats = measures[0][i], measures[4][i]
                bad = [n < 50, 100 * repeats > 50 * n]
                failed.append(any(bad))
                named = dict(zip((r.name for r in BASE_RULES), bad, strict=True))
                why.append(next((r.name for r in first or BASE_RULES if named[r.name]), None))
                if not failed[-1]:
                    alive.append((i, d))
            for rule in rest:
                passed = []
                for i, d in alive:
                    if rule.rejects(d):
                        why[i] = rule.name
                    else:
                        passed.append((i, d))
                alive = passed
            kept = [w is None and not f for w, f in zip(why, failed, strict=True)]
            return [*measures, failed, kept, why]

        return work

    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return extend(df, text, [StructField(c, LongType()) for c in longs]
                  + [StructField("base_failed", BooleanType()),
                     StructField("kept", BooleanType()),
                     StructField("rejected_by", StringType())], build, keep)
