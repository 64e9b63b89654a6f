"""Secrets by pattern, and strings that a battery of randomness tests takes for keys.

Base spans are matches of three patterns. Beyond them, runs of 16 or more
letters, digits and ``+/_-`` are candidates. The smallest alphabet that holds a
candidate's symbols is taken for its encoding, and three statistics describe it
there: chi-squared of its symbol counts, runs of the alphabet's lower and upper
half, and the serial correlation of neighbours.

Each statistic is read twice. As a test of randomness: the three chances are
combined by Fisher's rule, and a candidate that uniform draws would hardly give
is put aside. And as evidence against ordinary text: how far is the statistic
off what text in this encoding has, towards uniform draws? Text is modelled by
the neighbouring symbols of the shorter runs of that encoding in the whole
corpus, so that capitals inside identifiers, say, are ordinary among letters of
both cases. The three deviates are added by Stouffer's rule, none of them
counting more than ``CLIP``, so one odd feature alone makes no key.

Chances of all candidates of the corpus pass a weighted step-up rule that keeps
the expected share of ordinary strings among the spans below ``RATE``. A
candidate's weight is the power of the tests at its length and encoding, over
the mean power: short strings, and alphabets in which text looks random anyway
(digits), spend little of the allowance, long ones more.

Defined cases: null and empty texts have no spans. Rows that repeat an id are
separate, null ids stay null. Candidates that touch a base span count in the
rule but add no span. Without candidates the rule has no effect.
"""

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import packed
from tickloom.llm.kernels import chunked
from tickloom.session import materialize

ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
KINDS = ("assign", "access", "hex", "random")
LEAST_RANDOM = 16

# Alphabets in the order in which their symbols are numbered, smallest first.
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = {
    "decimal": DIGITS, "hex": DIGITS + "abcdef", "upper_hex": DIGITS + "ABCDEF", "upper": UPPER, "lower": LOWER,
    "base32": "234567" + UPPER, "upper_digits": DIGITS + UPPER, "lower_digits": DIGITS + LOWER, "letters": UPPER + LOWER,
    "alphanumeric": DIGITS + UPPER + LOWER, "base64": DIGITS + UPPER + LOWER + "+/", "base64url": DIGITS + UPPER + LOWER + "-_",
    "mixed": DIGITS + UPPER + LOWER + "+/-_",
}
SYMBOLS = ENCODINGS["mixed"]
PLACE = {symbol: i for i, symbol in enumerate(SYMBOLS)}

RANDOM_LEVEL = 0.001  # a candidate less likely than this under uniform draws is not random
POWER_LEVEL, POWER_DEVIATE = 0.001, -3.0902  # power is the chance that a random string gets below this; its normal quantile
RATE = 0.01  # allowed share of ordinary strings among the added spans
CLIP = 4.0  # most that one test's deviate adds to the evidence
POOLED = 1_000  # neighbours of all encodings that the model of each one starts from
STEPS, MOST = 100, 300  # chances are ranked in hundredths of a power of ten, down to 10**-300
POWER_UNIT = 1_000_000


# --- spans ------------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def patterns():
    whole_runs = rf"(?<![{re.escape(SYMBOLS)}])[{re.escape(SYMBOLS)}]{{{LEAST_RANDOM},}}"
    return (
        re.compile(ASSIGN, re.IGNORECASE | re.ASCII),
        re.compile(ACCESS),
        # A run of hex digits is matched whole or not at all, so its least length can be in the pattern.
        re.compile(rf"[0-9a-f]{{{LEAST_HEX},}}"),
        re.compile(whole_runs),
    )


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind; kinds are places in ``KINDS``."""
    assign, access, hexes, _ = patterns()
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    found += [(m.start(), 1, m.end()) for m in access.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in hexes.finditer(text)]
    return sorted(found)


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Spans of whole runs of symbols that are long enough."""
    return (m.span() for m in patterns()[3].finditer(text))


def encoding_of(text: str) -> str:
    """The smallest alphabet that holds all symbols of a text of ``SYMBOLS``."""
    used = set(text)
    return next(name for name, alphabet in ENCODINGS.items() if used <= set(alphabet))


# --- tests --------------------------------------------------------------------------------------


def normal_below(z: float) -> float:
    return math.erfc(-z / math.sqrt(2)) / 2


def two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def fisher(chances: list[float]) -> float:
    """Combined chance of independent ones: the chi-squared tail with twice as many degrees of freedom."""
    half = -sum(math.log(max(chance, 1e-300)) for chance in chances)
    return math.exp(-half) * sum(half ** k / math.factorial(k) for k in range(len(chances)))


def chi_tail(value: float, freedom: float, variance: float) -> float:
    """Upper tail of a statistic with the mean and variance of a gamma variable, by the Wilson-Hilferty cube root."""
    shape = freedom * freedom / variance
    root, mean = (value / freedom) ** (1 / 3), 1 - 1 / (9 * shape)
    return normal_below(-(root - mean) * 3 * math.sqrt(shape))


class Alphabet:
    """One encoding: what its statistics are like for uniform draws and for text of the corpus."""

    def __init__(self, name: str, pairs: np.ndarray):
        symbols = ENCODINGS[name]
        self.size = k = len(symbols)
        self.place = {symbol: i for i, symbol in enumerate(symbols)}
        at = np.ix_(*[[PLACE[symbol] for symbol in symbols]] * 2)
        pooled = pairs.sum(axis=0)[at] + 1.0 / (k * k)  # a little of uniform pairs, so that no alphabet is unseen
        pairs = pairs[list(ENCODINGS).index(name)][at] + POOLED * pooled / pooled.sum()
        chance = pairs / pairs.sum()
        first, second = chance.sum(axis=1), chance.sum(axis=0)
        symbol = (first + second) / 2
        self.squares, self.cubes = float((symbol ** 2).sum()), float((symbol ** 3).sum())
        upper = np.arange(k) >= k / 2
        self.half = int(math.ceil(k / 2))
        even = float(upper.mean())
        self.change_random = 2 * even * (1 - even)
        self.change_text = float(chance[np.ix_(upper, ~upper)].sum() + chance[np.ix_(~upper, upper)].sum())
        values = np.arange(k)
        spread = math.sqrt(float((first * values ** 2).sum() - (first * values).sum() ** 2)
                           * float((second * values ** 2).sum() - (second * values).sum() ** 2))
        shared = float((chance * np.outer(values, values)).sum() - (first * values).sum() * (second * values).sum())
        self.serial_text = shared / spread if spread > 0 else 0.0

    def statistics(self, text: str) -> tuple[float, int, float]:
        """(chi-squared, changes between the halves, serial correlation)."""
        values = np.array([self.place[symbol] for symbol in text])
        n = len(values)
        chi = self.size / n * float((np.bincount(values).astype(float) ** 2).sum()) - n
        changes = int((np.diff((values >= self.half).astype(int)) != 0).sum())
        centred = values - values.mean()
        whole = float((centred ** 2).sum())
        return chi, changes, float((centred[1:] * centred[:-1]).sum()) / whole if whole else 1.0

    def moments(self, n: int) -> list[tuple[float, float, float, float]]:
        """Per statistic mean and deviation for uniform draws, then for text."""
        k, pairs = self.size, n * (n - 1) / 2

        def chi(squares, cubes):
            meets = pairs * (squares - squares ** 2) + n * (n - 1) * (n - 2) * (cubes - squares ** 2)
            return k * (1 + (n - 1) * squares) - n, 2 * k / n * math.sqrt(max(meets, 1e-12))

        def changes(rate):
            return (n - 1) * rate, math.sqrt((n - 1) * max(rate * (1 - rate), 1e-6))

        return [
            (*chi(1 / k, 1 / k ** 2), *chi(self.squares, self.cubes)),
            (*changes(self.change_random), *changes(self.change_text)),
            (-1 / n, math.sqrt(1 / n), self.serial_text - 1 / n, math.sqrt(1 / n)),
        ]

    def looks_random(self, text: str) -> float:
        """Combined chance of statistics at least as odd under uniform draws."""
        n = len(text)
        (chi, changes, serial), (of_chi, of_changes, of_serial) = self.statistics(text), self.moments(n)
        return fisher([
            chi_tail(max(chi, 1e-9), of_chi[0], of_chi[1] ** 2),
            two_sided((abs(changes - of_changes[0]) - 0.5) / of_changes[1]) if abs(changes - of_changes[0]) > 0.5 else 1.0,
            two_sided((serial - of_serial[0]) / of_serial[1]),
        ])

    def against_text(self, text: str) -> float:
        """Chance that text is so far off its own means, towards those of uniform draws."""
        total = 0.0
        for value, (random, _, mean, deviation) in zip(self.statistics(text), self.moments(len(text)), strict=True):
            total += max((value - mean) / deviation * (1 if random < mean else -1), -CLIP)
        return normal_below(total / math.sqrt(3))

    @lru_cache(maxsize=None)  # noqa: B019  lives as long as its task
    def power(self, n: int) -> float:
        """Chance that a random string of that length gets below ``POWER_LEVEL``."""
        expected, variance = 0.0, 0.01
        for random, of_random, mean, deviation in self.moments(n):
            deviate = -abs(random - mean) / deviation
            expected += max(deviate, -CLIP)
            variance += (of_random / deviation) ** 2 if deviate > -CLIP else 0.0
        return normal_below((POWER_DEVIATE * math.sqrt(3) - expected) / math.sqrt(variance))


# --- Spark -----------------------------------------------------------------------------------------


def symbol_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per byte its symbol's number and its kind as one bit; per set of kinds the encoding's number."""
    kinds = ("0189", "234567", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+/", "-_")
    numbers, bits = np.full(256, len(SYMBOLS), np.uint16), np.zeros(256, np.uint8)
    for bit, members in enumerate(kinds):
        for symbol in members:
            numbers[ord(symbol)], bits[ord(symbol)] = PLACE[symbol], 1 << bit
    encodings = [list(ENCODINGS).index(encoding_of("".join(kinds[bit] for bit in range(8) if held >> bit & 1))) for held in range(256)]
    return numbers, bits, np.array(encodings)


def neighbour_counts(texts: DataFrame) -> np.ndarray:
    """(encoding x symbol x symbol): how often symbols stand next to each other in runs shorter than candidates."""
    kinds = len(SYMBOLS)

    def run(batches):
        numbers, bits, encodings = symbol_tables()
        counts = np.zeros(len(ENCODINGS) * kinds * kinds, np.int64)
        for batch in batches:
            for _, _, data, offsets in chunked(batch.column("text")):
                held = bits[data]
                fresh = np.ones(len(data) + 1, bool)  # where a run cannot go on
                fresh[1:-1] = held[:-1] == 0
                fresh[offsets] = True
                starts = np.flatnonzero(fresh[:-1] & (held > 0))
                if not len(starts):
                    continue
                stops = np.flatnonzero((held > 0) & ((np.append(held[1:], 0) == 0) | fresh[1:])) + 1
                short = stops - starts < LEAST_RANDOM
                encoding = np.repeat(encodings[np.bitwise_or.reduceat(held, starts)][short], (stops - starts - 1)[short])
                inner = np.zeros(len(data) + 1, np.int8)
                inner[starts[short]] += 1
                inner[stops[short] - 1] -= 1
                at = np.flatnonzero(np.cumsum(inner[:-1], dtype=np.int8))
                symbols = numbers[data].astype(np.int64)
                counts += np.bincount((encoding * kinds + symbols[at]) * kinds + symbols[at + 1], minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some])], ["place", "n"])

    out = np.zeros(len(ENCODINGS) * kinds * kinds, np.int64)
    for place, n in texts.select("text").mapInArrow(run, "place int, n bigint").groupBy("place").agg(F.sum("n")).collect():
        out[place] = n
    return out.reshape(len(ENCODINGS), kinds, kinds)


SPAN = "struct<start:int,kind:int,end:int>"
CANDIDATE = "struct<start:int,end:int,encoding:string,exponent:int,power:int>"


def scanned(texts: DataFrame, pairs: np.ndarray) -> DataFrame:
    """(doc_id, base, found): base spans and candidates of each text.

    ``exponent`` is minus the logarithm of a candidate's chance, in hundredths, ``power`` in millionths.
    """
    def run(batches):
        alphabets = {name: Alphabet(name, pairs) for name in ENCODINGS}
        span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
        candidate = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("encoding", pa.string()), ("exponent", pa.int32()), ("power", pa.int32())])
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                rows = batch.slice(low, 500)
                base, found = [], []
                for text in rows.column("text").to_pylist():
                    text = text or ""
                    spans = base_spans(text)
                    base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
                    mine = []
                    for start, end in candidates(text):
                        piece = text[start:end]
                        name = encoding_of(piece)
                        alphabet = alphabets[name]
                        chance = alphabet.against_text(piece) if alphabet.looks_random(piece) >= RANDOM_LEVEL else 1.0
                        exponent = int(min(-math.log10(max(chance, 1e-300)), MOST) * STEPS)
                        touched = any(s < end and start < e for s, _, e in spans)
                        mine.append({"start": -1 if touched else start, "end": end, "encoding": name,
                                     "exponent": exponent, "power": max(1, int(alphabet.power(end - start) * POWER_UNIT))})
                    found.append(mine)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(base, pa.list_(span)), pa.array(found, pa.list_(candidate))], ["doc_id", "base", "found"])

    return texts.select("doc_id", "text").mapInArrow(run, f"doc_id bigint, base array<{SPAN}>, found array<{CANDIDATE}>")


def weighted_exponent(exponent: Column, power: Column, mean_power: float) -> Column:
    """The exponent of a chance divided by its weight, in whole hundredths."""
    return F.floor(exponent + F.log10(power / F.lit(mean_power)) * STEPS)


def step_up(found: DataFrame, rate: float) -> tuple[float, int | None]:
    """(mean power, least weighted exponent that is found) over all candidates; None if none is.

    Candidates are counted per exponent, at most ``STEPS * MOST`` counts and some more for the weights.
    """
    count, power = found.agg(F.count(F.lit(1)), F.sum("power")).first()
    if not count:
        return 1.0, None
    mean = power / count
    level = weighted_exponent(F.col("exponent"), F.col("power"), mean).alias("level")
    counted = found.select(level).groupBy("level").count().orderBy(F.desc("level")).collect()
    seen, least = 0, None
    for row in counted:
        seen += row["count"]
        if -row["level"] / STEPS <= math.log10(rate * seen / count):
            least = row["level"]
    return mean, least


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, base, spans): arrays of (start, kind, end) by start, then kind, ends exclusive, in code points.

    ``base`` holds the matches of the patterns, ``spans`` these and the random strings. ``kind`` is a place in ``KINDS``.
    """
    texts = packed(docs).select(F.col("row.doc_id").cast("bigint").alias("doc_id"), F.col("row.text").alias("text"))
    whole = materialize(scanned(texts, neighbour_counts(texts)), "secret-candidates")
    mean, least = step_up(whole.select(F.inline("found")), rate)
    if least is None:
        return whole.select("doc_id", "base", F.col("base").alias("spans"))
    keys = F.filter("found", lambda c: (c["start"] >= 0) & (weighted_exponent(c["exponent"], c["power"], mean) >= least))
    random = F.transform(keys, lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), c["end"].alias("end")))
    return whole.select("doc_id", "base", F.array_sort(F.concat("base", random)).alias("spans"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("bigint")
