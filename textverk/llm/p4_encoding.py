"""Lines garbled by a wrong character encoding, and their repair by round trips.

A line is re-encoded under the encoding it may wrongly have been read in and strictly
decoded in the one it may have been written in; the result is accepted when the garbling
cost drops, and the step is repeated for nested layers. The cost is the surprisal of the
line's character trigrams, counted over the whole corpus in a table of fixed size, so what
is broadcast does not grow with the data. Where a byte was lost (U+FFFD or '?'), the line
is a case, and the likeliest letter is put back where the trigrams leave no doubt.

Cases: a null text has no line; blank and clean lines give no row; a text of any length is
read whole; symbols, foreign names and foreign scripts that are meant keep a lower cost as
they are and so are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textverk.llm.kernel import codes_of, lines_of, slices
from textverk.sources.tables import spread

BITS = 19
GAIN = 4.0  # nats by which the cost must drop
# (read as, written as): fixed values
ROUTES = (
    ("cp1252", "utf-8"), ("latin-1", "utf-8"), ("mac_roman", "utf-8"), ("cp850", "utf-8"), ("cp437", "utf-8"), ("cp1253", "utf-8"),
    ("cp850", "cp1252"), ("cp437", "cp1252"), ("iso8859_7", "cp1252"), ("cp1253", "cp1252"), ("mac_roman", "cp1252"), ("cp1251", "cp1252"), ("cp1250", "cp1252"), ("koi8_r", "cp1252"),
    ("cp1252", "mac_roman"), ("latin-1", "mac_roman"), ("cp1252", "cp850"), ("latin-1", "cp850"), ("cp1252", "cp437"), ("mac_roman", "cp850"),
)
SEVEN_BIT = str.maketrans("{}|[]\\", "äåöÄÅÖ")  # Swedish 7-bit text read as ASCII
LOST = "åäöÅÄÖ–”…é»"  # what a lost character may have been
# Characters that alone give no suspicion, besides ASCII and whole scripts: fixed values
PLAIN = "åäöÅÄÖéüèàâãßÜ –—−”“„’‘»«›‹•·→▪■●§µ²³±°…­‐‑¬½£€¤©××№"
SCRIPTS = "̀-ͯ؀-ۿऀ-ॿ฀-๿​-‏　-〿一-鿿＀-￯"
_ODD = rf"[^\x09\x0a\x0d\x20-\x7e{PLAIN}{SCRIPTS}]"
_NEAR = r"[€…¤£½©°·¬§•„“][a-zåäö]|[a-zåäö][€¤£½©°§µ²³±¬•„][a-zåäö]|Â[^\sa-z]|â€|ö[A-ZÅÄÖ]|[.!?0-9]ö|à¸|à¤"
_SEVEN = r"[A-Za-z][{}|\\\[\]][a-z]|[{}|\\\[\]][a-z]{2}|[a-z]{2}[{}|]|(?<![^\s(])[{}|\\\[\]][a-z](?![^\s.,])|(?<![^\s])[a-z][{}|](?![^\s.,])|[A-Z][\[\]\\][A-Z]"
_MARK = r"\?[ \t]*[a-zåäö]|\?[A-Za-zÅÄÖåäö]|[a-zåäö]\?[A-Za-z]|(?<!\S)\?|(?<![^\s])[A-Za-z]{1,2}\?|[.!,?]\?|[A-Z]\?[A-Z]|\d\?[A-Za-z]"
TRIGGER = "|".join((_ODD, _NEAR, _SEVEN, _MARK))
KEPT = re.compile(r"[\x09\x20-\x7e" + PLAIN + "áêëíóôúçñÀÂÃÊÜ®¥]*")  # what a one-byte repair may give
DONE = re.compile(r"[\x00-\x7eåäöÅÄÖé–”…»•]*")  # no further layer is looked for
_PAIR = re.compile(r"[^\x00-\x7f]{2}")
_RUN = re.compile(r"[^\x00-\x7f]+")


def _index(c: np.ndarray) -> np.ndarray:
    """Table cells of the trigrams of a run of code points, or of the rows of three."""
    c = c.astype(np.uint64)
    p, q, r = (c[:, 0], c[:, 1], c[:, 2]) if c.ndim == 2 else (c[:-2], c[1:-1], c[2:])
    with np.errstate(over="ignore"):
        x = (p * np.uint64(0x9E3779B1) + q) * np.uint64(0x85EBCA77) + r
        x *= np.uint64(0xC2B2AE3D27D4EB4F)
    return (x >> np.uint64(64 - BITS)).astype(np.int64)


def trigram_counts(df: DataFrame, text: str) -> np.ndarray:
    """Counts of all texts' trigrams in a table of 2**BITS cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, dtype=np.int64)
        for b in batches:
            texts = b.column(0).to_pylist()
            for i, j in slices(texts):
                codes, _ = codes_of(["\n" + t for t in texts[i:j]] + ["\n\n"])
                total += np.bincount(_index(codes), minlength=1 << BITS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["k", "n"])

    got = df.select(text).filter(F.col(text).isNotNull()).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << BITS, dtype=np.int64)
    out[got["k"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=np.int64)
    return out


class Repair:
    def __init__(self, counts: np.ndarray) -> None:
        total = max(1, int(counts.sum()))
        self.cost_of = (np.log(total) - np.log(counts + 0.02)).astype(np.float32)
        self.most = 0.72 * np.log(total)  # mean surprisal of a line that still reads like text
        self.seen: dict[str, tuple[str, str | None, str] | None] = {}
        self.trigger, self.seven, self.mark = re.compile(TRIGGER), re.compile(_SEVEN), re.compile(_MARK)

    def cost(self, s: str) -> float:
        return float(self.cost_of[_index(np.frombuffer(f"\n{s}\n".encode("utf-32-le", "surrogatepass"), np.uint32))].sum())

    @staticmethod
    def _encode(s: str, enc: str) -> bytes | None:
        """Bytes of ``s``; characters that stand for undefined bytes are those bytes."""
        try:
            return s.encode(enc)
        except UnicodeEncodeError:
            if enc not in ("cp1252", "cp1253"):
                return None
        try:
            return _RUN.sub(lambda m: "".join(chr(ord(c)) if 0x80 <= ord(c) < 0xA0 else chr(c.encode(enc)[0]) for c in m[0]), s).encode("latin-1")
        except UnicodeEncodeError:
            return None

    def _round(self, s: str) -> tuple[str, str, float] | None:
        """The best single step (text, name of the route, cost) whose cost is lower by GAIN."""
        tried: dict[str, str] = {}
        raws: dict[str, bytes | None] = {}
        pairs = _PAIR.search(s) is not None
        for wrong, true in ROUTES:
            if true == "utf-8" and not pairs:
                continue
            if true != "utf-8" and any(name.startswith("utf-8") for name in tried.values()):
                break  # valid multi-byte sequences do not arise by chance
            if wrong not in raws:
                raws[wrong] = self._encode(s, wrong)
            raw, t = raws[wrong], None
            if raw is not None:
                try:
                    t = raw.decode(true)
                except UnicodeDecodeError:
                    pass
            if t is None and true == "utf-8" and wrong in ("cp1252", "latin-1", "mac_roman"):
                t = self._runs(s, wrong, true)
            if t is None or t == s or t in tried or true != "utf-8" and not KEPT.fullmatch(t):
                continue
            tried[t] = f"{true} as {wrong}"
        if not tried:
            return None
        c, t = min((self.cost(t), t) for t in tried)
        return (t, tried[t], c) if c < self.cost(s) - GAIN else None

    def likely(self, t: str, c: float) -> bool:
        """Whether the restored line reads like text of the corpus, not like noise."""
        return c < self.most * (len(t) + 2)

    def _runs(self, s: str, wrong: str, true: str) -> str | None:
        def one(m: re.Match) -> str:
            raw = self._encode(m[0], wrong)
            try:
                return m[0] if raw is None else raw.decode(true)
            except UnicodeDecodeError:
                return m[0]

        return _RUN.sub(one, s)

    def _seven(self, s: str) -> tuple[str, str, float] | None:
        words = s.split(" ")
        out = [w.translate(SEVEN_BIT) if re.search(r"[{}|\[\]\\]", w) and re.search(r"[A-Za-z]", w) else w for w in words]
        t = " ".join(out)
        if t == s:
            return None
        c = self.cost(t)
        return (t, "7-bit as ascii", c) if c < self.cost(s) - GAIN and self.likely(t, c) else None

    def _lost(self, s: str, mark: str) -> tuple[str, int]:
        """Puts the likeliest character in place of each mark where it is likelier by GAIN."""
        n = 0
        for _ in range(2):  # the second time with the neighbours that the first put in place
            x = np.frombuffer(f"\n\n{s}\n\n".encode("utf-32-le", "surrogatepass"), np.uint32)
            at = np.flatnonzero(x == ord(mark))
            if not len(at):
                break
            win = np.repeat(x[at[:, None] + np.arange(-2, 3)][:, None, :], len(LOST) + 1, axis=1)
            win[:, 1:, 2] = [ord(ch) for ch in LOST]
            cost = sum(self.cost_of[_index(win[:, :, k : k + 3].reshape(-1, 3))] for k in range(3)).reshape(len(at), -1)
            best = cost[:, 1:].argmin(axis=1)
            put = np.flatnonzero(cost[:, 0] - cost[np.arange(len(at)), best + 1] > GAIN)
            if not len(put):
                break
            out = list(s)
            for i in put.tolist():
                out[at[i] - 2] = LOST[best[i]]
            s, n = "".join(out), n + len(put)
        return s, n

    def line(self, s: str) -> tuple[str, str | None, str] | None:
        """(cause, restored line or None, line) if the line is garbled."""
        if s not in self.seen:
            if len(self.seen) > 50_000:
                self.seen.clear()
            self.seen[s] = self._line(s)
        return self.seen[s]

    def _line(self, s: str) -> tuple[str, str | None, str] | None:
        t, names = s, []
        if not s.isascii():
            while not (names and DONE.fullmatch(t)) and (got := self._round(t)) is not None:  # each step lowers the cost by GAIN, so it ends
                t = got[0]
                names.append(got[1])
            if names and not self.likely(t, self.cost(t)):  # noise that happened to decode
                t, names = s, []
        if self.seven.search(t) and (got := self._seven(t)):
            t = got[0]
            names.append(got[1])
        if "�" in t:
            u = re.sub("��?", "�", t)
            u, n = self._lost(u, "�")
            return "lost bytes", u if n and "�" not in u else None, s
        if "?" in t and self.mark.search(t):
            u, n = self._lost(t, "?")
            if n and self.likely(u, self.cost(u)):
                t = u
                names.append("lost to ?")
        if names:
            return "; ".join(names), t, s
        if not s.isascii() and re.search(r"[\x80-\x84\x86-\x9f]|Ã[\x80-\xbfŒ-™]|â€|√[^\s\d]", s):
            return "unknown", None, s
        return None


class Suspects:
    """Finds the lines of a batch that need a look, by array operations on code points."""

    _SPECIAL = "{|}[]\\?€…¤£½©°·¬§•„“µ²³±Âàâ"

    def __init__(self) -> None:
        self.odd = re.compile(_ODD)
        self.table = np.zeros(0x110000, dtype=bool)
        self.known = np.zeros(0x110000, dtype=bool)
        self.special = np.array([ord(c) for c in self._SPECIAL], dtype=np.uint32)

    def lines(self, codes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end, text index and number of the lines."""
        new = ~self.known[codes]
        if new.any():
            for c in np.unique(codes[new]).tolist():
                self.table[c] = chr(c) in self._SPECIAL or self.odd.match(chr(c)) is not None
                self.known[c] = True
        hit = self.table[codes]
        o = np.flatnonzero(codes == ord("ö"))  # a closing quotation mark may have become one
        if len(o):
            before, after = codes[np.maximum(o - 1, 0)], codes[np.minimum(o + 1, len(codes) - 1)]
            hit[o] |= (before < 64) & (before > 32) | (after >= 65) & (after <= 90)
        start, end, rec, number = lines_of(codes, off)
        n = np.zeros(len(codes) + 1, dtype=np.int64)
        np.cumsum(hit, out=n[1:])
        keep = n[end] > n[start]
        return start[keep], end[keep], rec[keep], number[keep]


def garbled(df: DataFrame, rec: str, text: str) -> DataFrame:
    """rec_id, line_no, cause, restored (null where it can't be known) for each garbled line."""
    src = spread(df.filter(F.col(text).isNotNull()).select(F.col(rec).cast("long").alias("rec_id"), F.col(text).alias("text")), "rec_id")
    model = df.sparkSession.sparkContext.broadcast(trigram_counts(src, "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fix, look = Repair(model.value), Suspects()
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            out: list[tuple] = []
            for i, j in slices(texts):
                codes, off = codes_of(texts[i:j])
                if not len(codes):
                    continue
                for s, e, r, k in zip(*(x.tolist() for x in look.lines(codes, off)), strict=True):
                    line = texts[i + r][s - int(off[r]) : e - int(off[r])].rstrip("\r")
                    if fix.trigger.search(line) and (got := fix.line(line)):
                        out.append((ids[i + r], k, got[0], got[1]))
            cols = list(zip(*out, strict=True)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], names=["rec_id", "line_no", "cause", "restored"])

    return src.mapInArrow(run, "rec_id long, line_no int, cause string, restored string")
