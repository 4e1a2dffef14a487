"""Free-entered values mapped to a canonical list (problem 7).

The reference entries and their aliases form a trie.  A lazily determinised Levenshtein automaton
for the typed value walks it and returns every entry within a distance that depends on the entry's
length.  Characters that look alike are folded together on both sides, so they are no slip.

Defined results: null values and values that already are an entry give no row; a value with no
entry in reach, or with several equally near, gives ``unmatched``; blank values are unmatched; an
empty reference list leaves every value unmatched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNMATCHED = "unmatched"
#: Characters that are taken for one another.
LOOK_ALIKE = str.maketrans({"o": "0", "i": "1", "l": "1", "|": "1", "s": "5", "z": "2", "b": "8", "g": "6"})
#: Short forms of month names beside the first three letters.
EXTRA_SHORT = {"September": ["sept"]}
PART = re.compile(r"[^\W_]+")


def squash(text: str) -> str:
    """Letters and digits only, in lower case."""
    return "".join(PART.findall(text.lower()))


def fold(text: str) -> str:
    """Letters and digits in lower case, look-alike characters made equal."""
    return squash(text).translate(LOOK_ALIKE)


class Trie:
    """Reference paths; a node is a dict of children, ``""`` holds the entries that end there."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, path: str, entry: str) -> None:
        node = self.root
        for c in path:
            node = node.setdefault(c, {})
        node.setdefault("", set()).add(entry)

    def exact(self, path: str) -> set[str]:
        node = self.root
        for c in path:
            node = node.get(c)
            if node is None:
                return set()
        return node.get("", set())

    def within(self, word: str, limit: int) -> dict[str, int]:
        """Entries whose path is at most ``limit`` slips from ``word``, with their least distance."""
        cap = limit + 1
        states: dict[tuple[tuple[int, ...], str], tuple[int, ...]] = {}

        def step(state: tuple[int, ...], c: str) -> tuple[int, ...]:
            key = (state, c)
            if key not in states:
                row = [min(cap, state[0] + 1)]
                for i, w in enumerate(word):
                    row.append(min(cap, state[i + 1] + 1, row[i] + 1, state[i] + (w != c)))
                states[key] = tuple(row)
            return states[key]

        found: dict[str, int] = {}
        stack = [(self.root, tuple(min(cap, i) for i in range(len(word) + 1)))]
        while stack:
            node, state = stack.pop()
            for c, child in node.items():
                if c == "":
                    if state[-1] <= limit:
                        for entry in child:
                            found[entry] = min(found.get(entry, cap), state[-1])
                elif min(nxt := step(state, c)) <= limit:
                    stack.append((child, nxt))
        return found


def swaps_apart(a: str, b: str) -> int:
    """Slips between two strings when two neighbours that changed places count once."""
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before = before, row
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
    return row[-1]


class Mapper:
    """Maps values to entries.  ``paths``: (written form, entry); ``firm`` forms may be misspelt and stand among other words."""

    def __init__(self, codes: list[tuple[str, str]], names: list[tuple[str, str]], short: list[tuple[str, str]], numbers: dict[int, str], limit: int = 2) -> None:
        self.limit, self.numbers = limit, numbers
        self.codes, self.names, self.short = Trie(), Trie(), Trie()
        self.forms: dict[str, set[str]] = {}
        self.longest = 0
        self.memo: dict[str, str] = {}
        for trie, forms in ((self.codes, codes), (self.names, names), (self.short, short)):
            for form, entry in forms:
                if path := fold(form):
                    trie.add(path, entry)
                    if trie is not self.short:
                        self.longest = max(self.longest, len(path))
                        self.forms.setdefault(entry, set()).add(path)

    def __call__(self, value: str) -> str:
        if value not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[value] = self._find(value)
        return self.memo[value]

    def _exact(self, parts: list[str], trie: Trie, most: int | None = None) -> set[str]:
        """Entries written among the parts, each over as many parts as its path has; a form inside a longer written form is no mention of its own."""
        found: list[tuple[int, int, set[str]]] = []
        for i in range(len(parts)):
            node = trie.root
            for j in range(i, len(parts) if most is None else min(len(parts), i + most)):
                for c in parts[j]:
                    node = node.get(c)
                    if node is None:
                        break
                if node is None:
                    break
                if hit := node.get(""):
                    found.append((i, j + 1, hit))
        whole = [h for i, j, h in found if not any((a <= i and j <= b and b - a > j - i) for a, b, _ in found)]
        return set.union(*whole) if whole else set()

    def _find(self, value: str) -> str:
        raw = PART.findall(value.lower())
        parts = [p.translate(LOOK_ALIKE) for p in raw]
        whole = "".join(parts)
        if not whole:
            return UNMATCHED
        code = self._exact(parts, self.codes)
        name = self._exact(parts, self.names)
        if code:
            both = code & name
            return next(iter(code)) if len(code) == 1 else next(iter(both)) if len(both) == 1 else UNMATCHED
        if name:
            return next(iter(name)) if len(name) == 1 else UNMATCHED
        if short := self._exact(parts, self.short, 1):
            return next(iter(short)) if len(short) == 1 else UNMATCHED
        if self.numbers:
            given = {int(p) for p in raw if p.isascii() and p.isdigit() and len(p) <= 2}
            if all(p.isdigit() for p in raw) or len(given) == 1:
                hit = {self.numbers[g] for g in given if g in self.numbers}
                if len(hit) == 1 and len(given) == 1:
                    return hit.pop()
        return self._near(whole, parts)

    def _near(self, whole: str, parts: list[str]) -> str:
        # no piece that is longer than any form and the slips allowed can be near to one
        pieces, most = {whole}, self.longest + self.limit
        for i in range(len(parts)):
            piece = ""
            for part in parts[i:]:
                piece += part
                if len(piece) > most:
                    break
                if len(piece) >= 4 and not piece.isdigit():
                    pieces.add(piece)
        best: dict[str, tuple[int, int]] = {}
        for piece in pieces:
            if len(piece) > most:
                continue
            # among other words a short piece may have one slip
            slips = self.limit if piece == whole or len(piece) >= 6 else 1
            for trie in (self.codes, self.names):
                for entry, d in trie.within(piece, self.limit).items():
                    for form in self.forms[entry]:
                        # the distance allowed depends on the length of the form
                        if abs(len(form) - len(piece)) > self.limit or d > (1 if len(form) < 4 else self.limit):
                            continue
                        score = (d, swaps_apart(piece, form))
                        if score[1] <= slips:
                            best[entry] = min(best.get(entry, (9, 9)), score)
        if not best:
            return UNMATCHED
        least = min(best.values())
        nearest = [e for e, s in best.items() if s == least]
        return nearest[0] if len(nearest) == 1 else UNMATCHED


def map_values(df: DataFrame, row_id: Column, fields: dict[str, tuple[Column, Mapper, frozenset[str]]]) -> DataFrame:
    """(paper_id, field, canonical) of each value of the fields that is not null and not exactly an entry.

    No shuffle: values are mapped where they are read, and a worker maps a value once.
    """
    wanted = F.array(*(F.struct(F.lit(name).alias("field"), value.alias("value")) for name, (value, _, _) in fields.items()))
    rows = df.select(row_id.alias("paper_id"), F.explode(wanted).alias("f")).select("paper_id", "f.*").filter(F.col("value").isNotNull())
    entries = {name: known for name, (_, _, known) in fields.items()}
    mappers = {name: mapper for name, (_, mapper, _) in fields.items()}
    kind = dict(rows.dtypes)["paper_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, names, values = (batch.column(i).to_pylist() for i in range(3))
            keep = [(i, n, mappers[n](v)) for i, n, v in zip(ids, names, values, strict=True) if v not in entries[n]]
            columns = list(zip(*keep, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], names=["paper_id", "field", "canonical"])

    return rows.mapInArrow(run, f"paper_id {kind}, field string, canonical string")
