"""Problem 10: text garbled by a wrong character encoding.

Adjacent character pairs are scored by their mutual information over all documents, the improbable
stretches of each text are its maximum-scoring segments, and only inside them the inverse mappings are
tested: UTF-8 read as a single- or double-byte text (also twice), and one single-byte text read as
another. A mapping counts if what it restores is more usual in the corpus than what stood there.

Plain mutual information is highest for garbled pairs, whose characters hardly occur apart, so its cubic
variant is used, in which the joint probability enters with its third power. Shares are leave-one-out
(the text itself doesn't make its pairs usual) and never below ``FLOOR``, at every size of the corpus.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.session import spread, table

#: Power of the joint probability, and the score under which a pair is improbable.
POWER, IMPROBABLE = 3.0, -4.0
#: Least share of documents that is told from none; so the table of pairs has at most (mean distinct pairs of a
#: document) / FLOOR rows, whatever the corpus. Characters of a larger share than KNOWN may come out of a mapping.
FLOOR, KNOWN = 2e-5, 2e-4
#: A mapping of single-byte texts must gain so many nats, and so many more for each character it changes; a
#: stretch has a pair of a smaller share than RARE, and at most so many of the new pairs are below NEW_RARE.
COST, COST_CHAR, RARE, NEW_RARE, WEAK = 6.0, 2.0, 1.2e-3, 8e-4, 0.34
# Encodings that UTF-8 is read as.
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1254", "cp1257", "iso8859-2", "iso8859-15", "cp437", "cp850", "cp852", "mac_roman", "koi8-r", "cp866", "gbk", "big5", "cp932")
# Fixed values: (read as, meant) among single-byte encodings.
SWAPPED = (
    ("latin-1", "iso8859-2"), ("cp1252", "cp1250"), ("latin-1", "cp1251"), ("latin-1", "koi8-r"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("latin-1", "iso8859-5"),
    ("latin-1", "iso8859-7"), ("cp1252", "cp1253"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp850"),
    ("cp1252", "cp437"), ("cp1250", "cp1252"), ("cp1251", "cp1252"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("iso8859-2", "latin-1"), ("cp1253", "cp1252"), ("cp1251", "cp1253"),
    ("cp1252", "cp1254"), ("koi8-r", "cp1252"), ("cp1252", "cp1257"),
)


def char_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(k, n): documents of each character and of each adjacent pair with a character beyond ASCII. Partial counts leave the workers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for pdf in batches:
            for t in pdf["text"]:
                seen = set(t)
                if not t.isascii():
                    seen.update(t[i : i + 2] for i in range(len(t) - 1) if t[i] > "\x7f" or t[i + 1] > "\x7f")
                total.update(seen)
            if len(total) > 200_000:
                yield pd.DataFrame({"k": list(total), "n": list(total.values())})
                total = Counter()
        yield pd.DataFrame({"k": list(total), "n": list(total.values())}, columns=["k", "n"])

    src = df.select(F.col(text).alias("text")).where("text is not null and text <> ''")
    return src.mapInPandas(run, "k string, n bigint").groupBy("k").agg(F.sum("n").alias("n"))


def segments(scores: list[float]) -> list[tuple[int, int]]:
    """All maximal scoring segments [start, end) of a list of scores (one pass, linear)."""
    out: list[list[float]] = []  # start, end, sum before, sum after
    total = 0.0
    for i, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        new = [i, i + 1, total, total + s]
        total += s
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= new[2]:
                j -= 1
            if j < 0 or out[j][3] >= new[3]:
                out.append(new)
                break
            new = [out[j][0], new[1], out[j][2], new[3]]
            del out[j:]
    return [(int(a), int(b)) for a, b, *_ in out]


class Repairer:
    """Finds and mends garbled stretches, given the document counts of characters and pairs."""

    def __init__(self, counts: dict[str, int], docs: int):
        d = max(1, docs)
        self.share = {k: max(FLOOR, (v - 1) / d) for k, v in counts.items()}
        self.tables = {e: self._table(e) for e in READ_AS if e not in ("gbk", "big5", "cp932")}
        self.swaps = [(a, b, m) for a, b in SWAPPED if (m := self._swap(a, b))]
        self.hints = {e: self._hint(t) for e, t in self.tables.items()}
        self.scores: dict[str, float] = {}
        self.known = {k for k, v in counts.items() if len(k) == 1 and v - 1 >= KNOWN * d}

    @staticmethod
    def _table(enc: str) -> dict[str, int]:
        out = {}
        for b in range(128, 256):
            try:
                ch = bytes([b]).decode(enc)
            except UnicodeDecodeError:
                ch = chr(b)  # undefined bytes pass through as control characters
            out[ch] = b
        return out

    @staticmethod
    def _hint(table: dict[str, int]) -> re.Pattern:
        """What a UTF-8 sequence looks like in an encoding: a search that skips it for most texts."""
        chars = lambda a, b: "[" + re.escape("".join(c for c, v in table.items() if a <= v <= b)) + "]"
        more = chars(0x80, 0xBF)
        return re.compile(f"{chars(0xC2, 0xDF)}{more}|{chars(0xE0, 0xEF)}{more}{{2}}|{chars(0xF0, 0xF4)}{more}{{3}}")

    @staticmethod
    def _swap(read: str, meant: str) -> dict[str, str]:
        out = {}
        for b in range(128, 256):
            try:
                x, y = bytes([b]).decode(read), bytes([b]).decode(meant)
            except UnicodeDecodeError:
                try:
                    x, y = (chr(b), bytes([b]).decode(meant)) if read in ("cp1252", "latin-1") else ("", "")
                except UnicodeDecodeError:
                    continue
            if x and x != y:
                out[x] = y
        return out

    def logp(self, pair: str) -> float:
        return math.log(self.share.get(pair, FLOOR))

    def score(self, pair: str) -> float:
        """How improbable a pair is: positive below the threshold. What stands for lost bytes is never probable."""
        got = self.scores.get(pair)
        if got is None:
            got = 1.0 if LOST in pair else IMPROBABLE - (POWER * self.logp(pair) - self.logp(pair[0]) - self.logp(pair[1]))
            self.scores[pair] = got
        return got

    def stretches(self, text: str) -> list[tuple[int, int]]:
        """Improbable stretches [start, end) of ``text``, each of whole runs beyond ASCII.

        Pairs within ASCII, which no mapping can change, score -0.5 each; a gap of them is one item.
        """
        items: list[float] = []
        runs: list[tuple[int, int]] = []  # of each item; gaps have none
        last = 0
        for m in RUN.finditer(text):
            a, b = m.span()
            if a - 1 > last:
                items.append(-0.5 * (a - 1 - last))
                runs.append((-1, -1))
            lo, hi = max(0, a - 1), min(len(text), b + 1)
            for i in range(lo, hi - 1):
                items.append(self.score(text[i : i + 2]))
                runs.append((a, b))
            if hi - lo < 2:
                items.append(1.0)
                runs.append((a, b))
            last = b
        out: list[tuple[int, int]] = []
        for i, j in segments(items):
            inside = [r for r in runs[i:j] if r[0] >= 0]
            if inside:
                a, b = inside[0][0], inside[-1][1]
                if out and a < out[-1][1]:
                    out[-1] = (out[-1][0], max(b, out[-1][1]))
                else:
                    out.append((a, b))
        return out

    def _utf8(self, text: str, enc: str) -> tuple[str, int]:
        """``text`` with the UTF-8 sequences that ``enc`` hides put right, and their number."""
        out, i, hits = [], 0, 0
        t = self.tables.get(enc)
        while i < len(text):
            ch = text[i]
            if ch > "\x7f":
                if t is not None:
                    lead = t.get(ch, 0)
                    size = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
                    if size and i + size <= len(text):
                        raw = bytes([lead, *(t.get(c, 0) for c in text[i + 1 : i + size])])
                        try:
                            d = raw.decode("utf-8")
                        except UnicodeDecodeError:
                            d = ""
                        if d and (d in self.known or d < "ɐ"):
                            out.append(d)
                            i += size
                            hits += 1
                            continue
                else:
                    j = i
                    while j < len(text) and text[j] > "\x7f":
                        j += 1
                    try:
                        d = text[i : j].encode(enc).decode("utf-8")
                    except (UnicodeEncodeError, UnicodeDecodeError):
                        d = ""
                    if d and all(c in self.known for c in d if c > "\x7f"):
                        out.append(d)
                        hits += 1
                        i = j
                        continue
            out.append(ch)
            i += 1
        return "".join(out), hits

    def _gain(self, old: str, new: str) -> tuple[float, float]:
        """Mean log probability of the pairs beyond ASCII of both texts."""
        mean = lambda t: (lambda x: sum(x) / len(x) if x else 0.0)([self.logp(t[i : i + 2]) for i in range(len(t) - 1) if t[i] > "\x7f" or t[i + 1] > "\x7f"])
        return mean(old), mean(new)

    def mend(self, text: str) -> tuple[str, list[str], bool]:
        """(restored text, mappings used, whether a stretch is left whose bytes are lost)."""
        used: list[str] = []
        if text.isascii():
            return text, used, False
        spans = self.stretches(text)
        lost = LOST in text and any(LOST in text[a:b] for a, b in spans)
        while spans and (likely := [e for e in READ_AS if (self.hints[e] if e in self.hints else CJK).search(text)]):  # encoded twice or more
            votes: Counter = Counter()
            better = []
            for a, b in spans:
                before, after = text[max(0, a - 1) : a], text[b : b + 1]
                for enc in likely:
                    new, all_hits, gained = text[a:b], 0, None
                    while (step := self._utf8(new, enc))[1]:  # a text encoded twice gains only when it is decoded twice
                        new, all_hits = step[0], all_hits + step[1]
                        p, q = self._gain(before + text[a:b] + after, before + new + after)
                        if q > p and (gained is None or q > gained[2]):
                            gained = (all_hits, new, q)
                    if gained:
                        votes[enc] += gained[0]
                        better.append((a, b, gained[0], enc, gained[2], gained[1]))
            best: dict[tuple[int, int], tuple] = {}
            for a, b, hits, enc, q, new in better:
                k = (hits, votes[enc], q, enc, new)
                if k > best.get((a, b), (0,)):
                    best[a, b] = k
            for (a, b), (*_, enc, new) in sorted(best.items(), reverse=True):
                text = text[:a] + new + text[b:]
                used.append(f"utf-8 as {enc}")
            if not best:
                break
            spans = self.stretches(text)
        if not used and spans:
            text, name = self._swapped(text, spans)
            used += [name] if name else []
        return text, used, lost

    def _swapped(self, text: str, spans: list[tuple[int, int]]) -> tuple[str, str]:
        """The single-byte mapping that makes the improbable stretches usual, if one does."""
        rare, new_rare, plain = math.log(RARE), math.log(NEW_RARE), math.log(0.3)
        far = lambda s, i: s[i] > "\x7f" or s[i + 1] > "\x7f"
        spans = [(max(0, a - 1), min(len(text), b + 1)) for a, b in spans]
        spans = [(a, b) for a, b in spans if any(self.logp(text[i : i + 2]) < rare for i in range(a, b - 1) if far(text, i))]
        best = (0.0, "", "")
        for read, meant, m in self.swaps:
            gain, changed, weak, old_mass, pairs = 0.0, 0, 0, 0.0, 0
            for a, b in spans:
                s = text[a:b]
                new = "".join(m.get(c, c) for c in s)
                if new == s:
                    continue
                changed += sum(x != y for x, y in zip(s, new))
                for i in range(len(s) - 1):
                    if s[i] != new[i] or s[i + 1] != new[i + 1]:
                        p, q = self.logp(s[i : i + 2]), self.logp(new[i : i + 2]) if far(new, i) else plain
                        gain += q - p
                        old_mass += p
                        pairs += 1
                        weak += q < new_rare
            if not changed or old_mass / pairs > rare or weak > WEAK * pairs:
                continue
            if gain >= COST + COST_CHAR * changed and gain > best[0]:
                mapped = list(text)
                for a, b in spans:
                    mapped[a:b] = [m.get(c, c) for c in text[a:b]]
                best = (gain, "".join(mapped), f"{meant} as {read}")
        return (best[1], best[2]) if best[2] else (text, "")


LOST = "\ufffd"
RUN = re.compile(r"[^\x00-\x7f]+")
CJK = re.compile("[\u2e80-\u9fff\uf900-\ufaff\uff00-\uffef]")
RESULT = "doc_id bigint, restorable boolean, mapping string, text string"


def find_garbled(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, restorable, mapping, text) of every document with garbled text; ``text`` as far as it could be restored.

    Null, empty and ASCII texts are never garbled; whole texts are read. restorable is false where a
    stretch with replacement characters shows that bytes are gone.
    """
    d = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null and text is not null and text <> ''")
    counts = char_counts(d)
    total = d.count()
    rows = counts.where((F.col("n") - 1) > FLOOR * total).collect()  # bounded, see FLOOR
    model = spark.sparkContext.broadcast(({r["k"]: r["n"] for r in rows}, total))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fix = Repairer(*model.value)
        for pdf in batches:
            out = []
            for i, t in zip(pdf["doc_id"], pdf["text"]):
                new, used, lost = fix.mend(t)
                if used or lost:
                    out.append((i, not lost, ", ".join(sorted(set(used))) or None, new))
            yield pd.DataFrame(out, columns=["doc_id", "restorable", "mapping", "text"])

    return spread(d.where(~F.col("text").rlike(r"^\p{ASCII}*$"))).mapInPandas(run, RESULT)


def p10_restored(spark: SparkSession, base: str) -> DataFrame:
    return find_garbled(spark, table(spark, base, "documents"))


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    return p10_restored(spark, base).select("doc_id").distinct()
