"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary.  Each language gives a piece a
probability, estimated by expectation maximisation: forward and backward sums over
all segmentations of each word give expected piece counts.  A text's likelihood in a
language is the product over its words of the sum over all their segmentations, by
the forward algorithm; distinct words are scored once and remembered.  A model that
gives all pieces the same probability is scored beside the languages: a text that it explains
better than any of them is in none.
"""

from __future__ import annotations

import functools
import itertools
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import slices, table, trimmed

#: Labelled documents that a language is fitted on: whole ones in order of hash, at most
#: so many and of at most so many bytes together.
SAMPLE = 400
SAMPLE_BYTES = 4 << 20
ROUNDS = 3
#: Words of up to so many characters are scored together.
SHORT = 40
#: Characters of words that are scored at once.
TOGETHER = 50_000
#: Words whose scores a task remembers, and their characters.
REMEMBERED = 150_000
REMEMBERED_CHARACTERS = 8 << 20
#: Added to each piece's expected count, and the share of a sign without a piece.
PRIOR = 0.02
UNKNOWN = 1e-7
START = "▁"
_ASCII = re.compile("[a-z]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@functools.lru_cache(1)
def _word() -> re.Pattern:
    """A letter, then letters and combining marks, as ranges of code points."""

    def ranges(kinds: str) -> str:
        points = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] in kinds]
        firsts = [c for c, before in zip(points, [-2, *points]) if c != before + 1]
        lasts = [c for c, after in zip(points, [*points[1:], -2]) if c != after - 1]
        return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(firsts, lasts))

    return re.compile(f"[{ranges('L')}][{ranges('LM')}]*")


def words_of(text: str | None) -> list[str]:
    low = (text or "").lower()
    return [START + w for w in (_ASCII if low.isascii() else _word()).findall(low)]


@functools.lru_cache(2)
def pieces(path: str) -> dict[str, int]:
    """Piece: number, for the pieces that a word of words_of can hold."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    inner = lambda p: all(unicodedata.category(c)[0] in "LM" for c in p.removeprefix(START))
    known = [p for p in dict.fromkeys(found) if p and inner(p) and p == p.lower()]
    return {p: i for i, p in enumerate(known)}


class _Walk:
    """The pieces as a trie in arrays: from a state, a sign of ``points`` leads to the state
    ``to`` of its key; ``piece`` is the number of the piece that a state spells, or -1."""

    def __init__(self, known: dict[str, int]) -> None:
        state = {"": 0}
        for piece in known:
            for n in range(1, len(piece) + 1):
                state.setdefault(piece[:n], len(state))
        self.points = np.unique(np.fromiter((ord(s[-1]) for s in state if s), np.uint32))
        self.signs = len(self.points) + 1
        found = [(state[s[:-1]], ord(s[-1]), k) for s, k in state.items() if s]
        before, sign, to = (np.array(v, np.int64) for v in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        keys = before * self.signs + np.searchsorted(self.points, sign)
        order = np.argsort(keys)
        # A last key that nothing has, so that there is always one to compare with.
        self.keys, self.to = np.append(keys[order], -1), np.append(to[order], 0)
        self.piece = np.array([known.get(s, -1) for s in state], np.int32)
        self.longest = max(map(len, known), default=1)

    def signs_of(self, words: list[str]) -> np.ndarray:
        """For words of one length: the number of each sign, the last for one in no piece."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.searchsorted(self.points, points)
        known = np.append(self.points, np.uint32(0xFFFFFFFF))[at] == points
        at = np.where(known, at, self.signs - 1)
        return at.reshape(len(words), -1)

    def step(self, state: np.ndarray, sign: np.ndarray) -> np.ndarray:
        """The state each of these leads to; -1 where there is none."""
        key = state * self.signs + sign
        at = np.searchsorted(self.keys[:-1], key)
        return np.where(self.keys[at] == key, self.to[at], -1)


_WALKS: dict[int, tuple[dict, _Walk]] = {}


def _walk(known: dict[str, int]) -> _Walk:
    held = _WALKS.get(id(known))
    if held is None or held[0] is not known:
        held = _WALKS[id(known)] = known, _Walk(known)
    return held[1]


def _by_length(words: list[str], known: dict[str, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in words, pieces): pieces[i, end, n] is the piece of n characters of the
    i-th of these words that ends at ``end``; the unknown sign's number for a single
    character that is no piece; -1 for others."""
    groups: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        groups.setdefault(len(w), []).append(k)
    walk = _walk(known)
    for length, places in groups.items():
        step = max(1, TOGETHER // max(1, length))
        for at in range(0, len(places), step):
            part = places[at : at + step]
            ids = np.full((len(part), length + 1, walk.longest + 1), -1, np.int32)
            ids[:, 1:, 1] = len(known)
            sign = walk.signs_of([words[k] for k in part])
            # All places at once, sign by sign, as long as some piece goes on.
            word, start = (v.ravel() for v in np.indices((len(part), length)))
            state = np.zeros(len(word), np.int64)
            for n in range(1, min(length, walk.longest) + 1):
                inside = start + n <= length
                word, start, state = word[inside], start[inside], state[inside]
                state = walk.step(state, sign[word, start + n - 1])
                word, start, state = (v[state >= 0] for v in (word, start, state))
                piece = walk.piece[state]
                whole = piece >= 0
                ids[word[whole], start[whole] + n, n] = piece[whole]
            yield np.array(part), ids


def _used(ids: np.ndarray) -> list[list[int]]:
    """For each end: the lengths of the pieces that end there in any word."""
    return [np.flatnonzero(x).tolist() for x in (ids >= 0).any(axis=0)]


def _forward(ids: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward sums alpha[word, end, language], scaled at each end, and the logarithms
    of the scales.  p[piece, language] has a last row of zeros for no piece."""
    count, ends, _ = ids.shape
    alpha, logs = np.zeros((count, ends, p.shape[1])), np.zeros((count, ends))
    alpha[:, 0] = 1
    for end, lengths in enumerate(_used(ids)):
        if not end:
            continue
        for n in lengths:
            # alpha at an earlier end is in that end's scale
            alpha[:, end] += alpha[:, end - n] * np.exp(logs[:, end - n] - logs[:, end - 1])[:, None] * p[ids[:, end, n]]
        top = alpha[:, end].max(axis=1)
        alpha[:, end] /= top[:, None]
        logs[:, end] = logs[:, end - 1] + np.log(top)
    return alpha, logs


def _backward(ids: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same from the word's end, for p of one language: beta[word, start]."""
    count, ends, _ = ids.shape
    beta, logs = np.zeros((count, ends)), np.zeros((count, ends))
    beta[:, -1] = 1
    # A piece that starts at s and has n characters ends at s + n.
    starting: list[list[int]] = [[] for _ in range(ends)]
    for end, lengths in enumerate(_used(ids)):
        for n in lengths:
            starting[end - n].append(n)
    for start in range(ends - 2, -1, -1):
        for n in starting[start]:
            beta[:, start] += beta[:, start + n] * np.exp(logs[:, start + n] - logs[:, start + 1]) * p[ids[:, start + n, n], 0]
        top = beta[:, start].copy()
        beta[:, start] /= top
        logs[:, start] = logs[:, start + 1] + np.log(top)
    return beta, logs


def log_likelihoods(words: list[str], known: dict[str, int], p: np.ndarray) -> np.ndarray:
    """log of the sum over all segmentations, for each word and language."""
    out = np.zeros((len(words), p.shape[1]))
    short = [k for k, w in enumerate(words) if len(w) <= SHORT]
    for places, ids in _by_length([words[k] for k in short], known):
        alpha, logs = _forward(ids, p)
        out[np.array(short)[places]] = np.log(np.maximum(alpha[:, -1], 1e-300)) + logs[:, -1:]
    for k, w in enumerate(words):
        if len(w) > SHORT:
            out[k] = _long(w, known, p)
    return out


def _long(word: str, known: dict[str, int], p: np.ndarray) -> np.ndarray:
    """The same for one word of any length, keeping the last sums only."""
    longest = _walk(known).longest
    sums, log = [np.ones(p.shape[1])], 0.0
    for end in range(1, len(word) + 1):
        total = np.zeros(p.shape[1])
        for n in range(1, min(end, longest) + 1):
            found = known.get(word[end - n : end], len(known) if n == 1 else None)
            if found is not None:
                total = total + sums[-n] * p[found]
        top = total.max()
        log += np.log(top)
        sums = [s / top for s in [*sums, total][-longest:]]
    return np.log(np.maximum(sums[-1], 1e-300)) + log


def _expected(words: list[str], weight: np.ndarray, known: dict[str, int], p: np.ndarray) -> np.ndarray:
    """Expected piece counts of weighted words in one language: forward times backward.
    Both are scaled, so that words may be of any length."""
    total = np.zeros(len(known) + 2)
    for places, ids in _by_length(words, known):
        (alpha, logs), (beta, back) = _forward(ids, p), _backward(ids, p)
        for end, lengths in enumerate(_used(ids)):
            for n in lengths:
                own, start = ids[:, end, n], end - n
                scale = np.exp(logs[:, start] + back[:, end] - logs[:, -1])
                share = alpha[:, start, 0] * p[own, 0] * beta[:, end] * scale / alpha[:, -1, 0]
                total += np.bincount(np.where(own < 0, len(known) + 1, own), weight[places] * share, len(known) + 2)
    total[-1] = 0
    return total


def fit(counts: dict[str, dict[str, int]], known: dict[str, int]) -> tuple[list[str], np.ndarray]:
    """Languages, and p[piece, language] with rows for the unknown sign and for no piece;
    the last column is the model of equal pieces."""
    languages = sorted(counts)
    out = np.zeros((len(known) + 2, len(languages) + 1))
    for k, language in enumerate([*languages, None]):
        p = np.zeros((len(known) + 2, 1))
        p[:-1, 0] = 1 / max(1, len(known))
        if language is not None:
            words = list(counts[language])
            weight = np.array([counts[language][w] for w in words], float)
            for _ in range(ROUNDS):
                expected = _expected(words, weight, known, p) + PRIOR
                expected[-1] = 0
                p[:, 0] = expected / expected.sum()
                p[-2, 0] = UNKNOWN
        p[-2, 0] = UNKNOWN
        out[:, k] = p[:, 0]
    return languages, out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, text to the task's words and their counts."""
    held: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            held.setdefault(lang, Counter()).update(words_of(text.as_py()))
    for lang, count in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(count), pa.string()), pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["lang", "word", "n"])


def sample_counts(docs: DataFrame) -> dict[str, dict[str, int]]:
    """Counts of all words of a bounded sample of documents with a language: whole ones
    of least hash, SAMPLE a language and SAMPLE_BYTES together (a longer one alone can't
    be chosen).  A first pass counts documents by language and sets the hash below
    which about twice the sample lies; no language's rows meet in a task."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    rows = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("lang").cast("string").alias("lang"), "text", place.alias("place"))
    totals = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()  # one row a language
    spark = docs.sparkSession
    limits = spark.createDataFrame([(r.lang, min(1 << 40, (1 << 40) * 2 * SAMPLE // r.n + 1)) for r in totals], "lang string, most long")
    near = rows.join(F.broadcast(limits), "lang").where(F.col("place") < F.col("most"))
    sizes = near.select("lang", "place", "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    chosen: list[tuple[str, int]] = []
    left: dict[str, list[int]] = {}
    for r in sorted(sizes.collect(), key=lambda r: (r.lang, r.place, r.doc_id)):  # about 2 * SAMPLE a language
        room = left.setdefault(r.lang, [SAMPLE, SAMPLE_BYTES])
        if room[0] and r["size"] <= room[1]:
            chosen.append((r.lang, r.doc_id))
            room[0] -= 1
            room[1] -= r["size"]
    if not chosen:
        return {}
    own = spark.createDataFrame(sorted(set(chosen)), "lang string, doc_id long")
    texts = near.join(F.broadcast(own), ["lang", "doc_id"]).select("lang", "text")
    found: dict[str, dict[str, int]] = {lang: {} for lang in left}
    counts = texts.mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    for r in counts.toLocalIterator():
        found[r.lang][r.word] = r.n
    return {lang: words for lang, words in found.items() if words}


class _Memory:
    """Rows of log-likelihoods of the words a task has met, bounded in words and characters."""

    def __init__(self, known: dict[str, int], p: np.ndarray) -> None:
        self.known, self.p = known, p
        self.place: dict[str, int] = {}
        self.rows, self.characters = np.zeros((1024, p.shape[1])), 0

    def learn(self, cut: list[list[str]]) -> None:
        words = set().union(*cut)
        new = [w for w in words if w not in self.place]
        if len(self.place) + len(new) > REMEMBERED or self.characters + sum(map(len, new)) > REMEMBERED_CHARACTERS:
            self.place, self.characters, new = {}, 0, list(words)
        at = len(self.place)
        self.characters += sum(map(len, new))
        self.place.update((w, at + i) for i, w in enumerate(new))
        if len(self.place) > len(self.rows):
            grown = np.zeros((len(self.place) * 3 // 2, self.rows.shape[1]))
            grown[:at] = self.rows[:at]
            self.rows = grown
        if new:
            self.rows[at : at + len(new)] = log_likelihoods(new, self.known, self.p)


def _predictor(languages: list[str], p: np.ndarray, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Memory(pieces(path), p)
        for batch in batches:
            for part in slices(batch, "text"):
                cut = [words_of(t) for t in part.column("text").to_pylist()]
                memory.learn(cut)
                sizes = np.array([len(words) for words in cut])
                rows = np.fromiter(map(memory.place.__getitem__, itertools.chain.from_iterable(cut)), np.int64, sizes.sum())
                totals = np.zeros((len(cut), p.shape[1]))
                if len(rows):
                    some = sizes > 0
                    totals[some] = np.add.reduceat(memory.rows[rows], (sizes.cumsum() - sizes)[some])
                said, sure, leads = [], [], []
                for words, total in zip(cut, totals):
                    if not languages or not words:
                        said.append("und")
                        sure.append(0.0)
                        leads.append(0.0)
                        continue
                    own = total[:-1]
                    share = np.exp((own - own.max()) / len(words))
                    said.append(languages[int(own.argmax())])
                    sure.append(float(share.max() / share.sum()))
                    leads.append(float((own.max() - total[-1]) / len(words)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(said, pa.string()), pa.array(sure, pa.float64()), pa.array(leads, pa.float64())], ["doc_id", "lang_pred", "score", "lead"])

    return run


def identify(docs: DataFrame, labelled: DataFrame, path: str | None = None) -> DataFrame:
    """Return (doc_id, lang_pred, score, lead) for each row of ``docs`` (doc_id, text); the
    languages are those of ``labelled`` (doc_id, text, lang); other columns are ignored.

    ``score`` is the language's share of the likelihood of a mean word; ``lead`` is
    the log of a mean word's likelihood in it less that by equal pieces: of 0 or
    less, the text is in no learned language.  Null, empty and letterless texts, and all
    texts if nothing is labelled, are 'und' with score and lead 0; ties go to the first
    language by name.  A null doc_id is no label's and is scored like others.  Rows
    are independent; an empty table gives an empty result.
    """
    path = path or default_vocabulary()
    languages, p = fit(sample_counts(labelled), pieces(path))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(trimmed(_predictor(languages, p, path)), "doc_id long, lang_pred string, score double, lead double")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    found = identify(docs, docs.where(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "lead")


QUERIES = {"op7_language_id": op7}
ORACLE: dict[str, str] = {}
