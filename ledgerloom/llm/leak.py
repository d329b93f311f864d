"""Evaluation passages inside a corpus, verbatim or with other slot values.

1. Texts become words: letter case, punctuation, spacing and line breaks are
   dropped, words divided at a line end are joined, bracketed interruptions removed.
2. Windows of ``WINDOW`` words are hashed twice: as they are, and as templates, in which
   numbers, units and names are typed placeholders.  A name is a word that its own text
   capitalises inside a sentence and never writes small, so names of the corpus that no item
   holds are placeholders too; a text that capitalises its nouns has no names.  A template
   counts if it holds a placeholder and at least ``LITERALS`` other words.
3. Corpus windows whose hash occurs among the item windows are hash-joined with them.
4. Equal words are a verbatim leak.  Of templates the words under the placeholders decide: a
   one-to-one renaming of slots is a re-parameterised leak, if at least ``LEAST`` windows of
   the document show it; anything else is none.

Step 2 streams over Arrow batches and keeps only windows whose hash an item window
has, so the join sees leaked passages, not the corpus.  The set of item hashes is
shipped to the tasks only while it has at most ``MAX_FILTER`` entries; beyond it every
window goes to the join, which Spark then shuffles.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.spread import spread

WINDOW = 12
LITERALS = 6
LEAST = 3
#: Words capitalised inside a sentence, as a share of all words, above which capitals do not tell names.
NOUN_CAPITALS = 0.15
#: Item windows up to which their hashes travel with the tasks (8 bytes each).
MAX_FILTER = 2_000_000

_BRACKETS = re.compile(r"\([^()]*\)|\[[^\[\]]*\]")
_DIVIDED = re.compile(r"(?<=[^\W\d_])[-‐­][ \t]*(?:\r\n|\r|\n)\s*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")
_DIGIT = re.compile(r"\d")

NUMBERS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion "
    "null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig dreissig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend".split()
)
UNITS = frozenset(
    "penny pennies pence pound pounds crown crowns dollar dollars cent cents euro euros shilling shillings inch inches foot feet yard yards mile miles metre metres meter meters kilometre kilometres ounce ounces gram grams kilo kilos kilogram kilograms ton tons litre litres gallon gallons acre acres percent km kg mm cm ml "
    "pfennig taler mark kronen meter kilometer gramm kilogramm liter prozent".split()
)


def _plain(text: str | None) -> str:
    """The text without brackets and with divided words joined."""
    if not text:
        return ""
    if "(" in text or "[" in text:
        before = None
        while before != text:  # nested brackets open from the inside
            before, text = text, _BRACKETS.sub(" ", text)
    if "\n" in text or "\r" in text:
        text = _DIVIDED.sub("", text)
    return text.replace("\u00ad", "")


def words(text: str | None) -> list[str]:
    """Words of a text as step 1 describes; NULL has none."""
    return _WORD.findall(_plain(text).casefold())


_CAPITAL_INSIDE = re.compile(r"(?<=[a-zß-ÿ,;] )[A-ZÀ-Þ][^\W\d_]{2,}")


def names_in(text: str) -> set[str]:
    """Words that a text capitalises inside a sentence and nowhere writes small."""
    capitals = [w for w in _CAPITAL_INSIDE.findall(text) if not w.isupper()]
    if not capitals:
        return set()
    names = set(capitals)
    if len(capitals) > NOUN_CAPITALS * (text.count(" ") + 1) and len(names) > 4:
        return set()
    return {w.casefold() for w in names if w.lower() not in text or not re.search(rf"(?<![^\W_]){w.lower()}(?![^\W_])", text)}


def canonical(word: str) -> str:
    if word in NUMBERS or _DIGIT.search(word):
        return "<number>"
    return "<unit>" if word in UNITS else word


class _Codes(dict):
    """Numbers words; their hash, their template hash and whether they are a slot stand in arrays."""

    def __init__(self) -> None:
        self.plain, self.template, self.slot = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64), np.zeros(1024, np.int64)

    def __missing__(self, word: str) -> int:
        n = len(self)
        if n == len(self.slot):
            self.plain, self.template, self.slot = (np.concatenate([x, np.zeros_like(x)]) for x in (self.plain, self.template, self.slot))
        t = canonical(word)
        self.plain[n], self.template[n], self.slot[n] = xxhash.xxh64_intdigest(word), xxhash.xxh64_intdigest(t, 1), t != word
        self[word] = n
        return n


_NAME = np.uint64(xxhash.xxh64_intdigest("<name>", 1))


class Windows:
    """Hashes of the windows of a text, as they are and as templates."""

    def __init__(self, width: int = WINDOW):
        self.width, self._codes = width, _Codes()
        with np.errstate(over="ignore"):
            self._powers = np.cumprod(np.full(width, 0x9E3779B97F4A7C15, np.uint64))

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_codes": _Codes()}

    def _rolled(self, code: np.ndarray) -> np.ndarray:
        out = np.correlate(code, self._powers, "valid")
        return (out ^ (out >> np.uint64(29))).view(np.int64)

    def of(self, text: str | None) -> tuple[list[str], set[str], np.ndarray, np.ndarray, np.ndarray]:
        """Words, names, hashes of all windows, places and hashes of the templates."""
        text = _plain(text)
        ws = _WORD.findall(text.casefold())
        n = len(ws) - self.width + 1
        none = np.empty(0, np.int64)
        if n <= 0:
            return ws, set(), none, none, none
        if len(self._codes) > 1 << 19:
            self._codes = _Codes()
        at = np.fromiter(map(self._codes.__getitem__, ws), np.int64, len(ws))
        plain = self._rolled(self._codes.plain[at])
        template, slot = self._codes.template[at], self._codes.slot[at]
        names = names_in(text)
        if names:
            is_name = np.isin(at, [self._codes[w] for w in names])
            template[is_name], slot[is_name] = _NAME, 1
        if not slot.any():
            return ws, names, plain, none, none
        sums = np.concatenate([[0], np.cumsum(slot)])
        slots = sums[self.width :] - sums[: -self.width]
        places = np.flatnonzero((slots > 0) & (slots <= self.width - LITERALS))
        return ws, names, plain, places, self._rolled(template)[places]

    def slots(self, window: list[str], names: set[str]) -> list[str]:
        return [w for w in window if w in names or canonical(w) != w]


def _emit(windows: Windows, wanted: np.ndarray | None, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = bits = None
        if wanted is not None:
            bits = 64 - max(10, min(26, int(len(wanted)).bit_length() + 4))
            mask = np.zeros(1 << (64 - bits), bool)
            mask[wanted.view(np.uint64) >> np.uint64(bits)] = True

        def kept(h: np.ndarray) -> np.ndarray:
            if mask is None:
                return np.arange(len(h))
            hits = np.flatnonzero(mask[h.view(np.uint64) >> np.uint64(bits)])
            if len(hits):
                at = np.searchsorted(wanted, h[hits])
                hits = hits[wanted[np.minimum(at, len(wanted) - 1)] == h[hits]]
            return hits

        schema = pa.schema([("id", id_type), ("hash", pa.int64()), ("pos", pa.int64()), ("words", pa.string()), ("slots", pa.list_(pa.string()))])
        for b in batches:
            ids, rows = b.column(0), []
            for i, text in enumerate(b.column(1)):
                ws, names, plain, at, templates = windows.of(text.as_py())
                for p in kept(plain).tolist():
                    rows.append((i, int(plain[p]), p, " ".join(ws[p : p + windows.width]), None))
                for k in kept(templates).tolist():
                    window = ws[at[k] : at[k] + windows.width]
                    rows.append((i, int(templates[k]), int(at[k]), " ".join(window), windows.slots(window, names)))
                if len(rows) > 20_000:
                    yield _batch(rows, ids, schema)
                    rows = []
            if rows:
                yield _batch(rows, ids, schema)

    return run


def _batch(rows: list[tuple], ids: pa.Array, schema: pa.Schema) -> pa.RecordBatch:
    i, h, p, w, s = zip(*rows)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(i)), pa.array(h, pa.int64()), pa.array(p, pa.int64()), pa.array(w), pa.array(s, pa.list_(pa.string()))], schema=schema)


def _windows_of(df: DataFrame, id_col: str, text_col: str, windows: Windows, wanted: np.ndarray | None) -> DataFrame:
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    kind = src.schema["id"].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    return spread(src).mapInArrow(_emit(windows, wanted, arrow), f"id {kind}, hash bigint, pos bigint, words string, slots array<string>")


def leaks(corpus: DataFrame, items: DataFrame, *, doc_id: str, text: str, item_id: str, passage: str, max_filter: int = MAX_FILTER) -> DataFrame:
    """(doc_id, item_id, kind, n_windows): kind is ``verbatim`` or ``reparameterised``.

    A document has at most one row per item; verbatim windows win over others.  Rows
    delivered again count once.  NULL ids or texts, and texts shorter than a window,
    leak nothing; passages shorter than a window cannot be found.  Ids are BIGINT, INT
    or STRING; columns not named here are ignored.  A window that many documents share is
    hot in the join only on the corpus side, where adaptive execution splits it.
    """
    windows = Windows()
    item_windows = _windows_of(items, item_id, passage, windows, None)
    found = [r[0] for r in item_windows.select("hash").distinct().limit(max_filter + 1).toLocalIterator()]
    wanted = np.sort(np.array(found, np.int64)) if len(found) <= max_filter else None
    left = item_windows.groupBy(F.col("id").alias(item_id), "hash", F.col("words").alias("i_words"), F.col("slots").alias("i_slots")).count().drop("count")
    right = _windows_of(corpus, doc_id, text, windows, wanted).select(F.col("id").alias(doc_id), "hash", "words", "slots", "pos")
    if wanted is not None and not len(wanted):
        right = right.limit(0)
    j = right.join(left, "hash")
    exact = F.col("slots").isNull() & F.col("i_slots").isNull() & (F.col("words") == F.col("i_words"))
    pairs = F.arrays_zip(F.col("i_slots").alias("a"), F.col("slots").alias("b"))
    n_pairs = F.size(F.array_distinct(pairs))
    renamed = (F.size("slots") == F.size("i_slots")) & (n_pairs == F.size(F.array_distinct("slots"))) & (n_pairs == F.size(F.array_distinct("i_slots"))) & (F.col("words") != F.col("i_words"))
    j = j.where(exact | renamed).groupBy(doc_id, item_id).agg(F.count_distinct(F.when(exact, F.col("pos"))).alias("n_exact"), F.count_distinct(F.when(renamed, F.col("pos"))).alias("n_renamed"))
    verbatim = F.col("n_exact") > 0
    kind = F.when(verbatim, "verbatim").otherwise("reparameterised").alias("kind")
    return j.where(verbatim | (F.col("n_renamed") >= LEAST)).select(doc_id, item_id, kind, F.when(verbatim, F.col("n_exact")).otherwise(F.col("n_renamed")).alias("n_windows"))
