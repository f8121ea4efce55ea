"""Language identification by cross-parsing entropy against suffix automata of labelled text."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallysmith.llm.hashing import batches
from tallysmith.llm.shared import held_out, small_batches

#: Training text: at most so many documents of a language, so many characters of each, so many characters over all
#: languages together, and so many languages, the most frequent ones.
FIT_DOCS, FIT_CHARS, ALL_CHARS, LANGUAGES = 64, 1_000, 240_000, 200
#: Symbols that are parsed in one go; a phrase ends where such a block ends.
BLOCK = 1_024
#: How much a difference of one per cent in phrases counts in the score.
SHARPNESS = 20.0
UNKNOWN = "und"


def training_texts(
    docs: DataFrame, modulus: int = 3, rest: int = 1, key: str = "doc_id", text: str = "text", lang: str = "lang",
    fit_docs: int = FIT_DOCS, fit_chars: int = FIT_CHARS, all_chars: int = ALL_CHARS, languages: int = LANGUAGES,
) -> dict[str, str]:
    """Bounded training text per language, from rows that are not held out, chosen by a hash of the key.

    A language is any non-null value of ``lang``; of more than ``languages`` the most frequent are learned.  Each of at
    most ``fit_docs`` documents gives up to ``fit_chars`` characters in a row, from a place drawn by a hash; fewer, if
    all together would be more than ``all_chars``.  So no more than that goes to the driver.
    """
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(key, modulus, rest))
    rows = rows.filter(F.trim(text) != "").select(
        F.col(lang).cast("string").alias("lang"), F.xxhash64(F.lit(5), key).alias("_draw"), F.col(text).alias("_whole")
    )
    counted = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    names = [r["lang"] for r in counted.collect()]
    if not names:
        return {}
    most = max(1, min(fit_chars, all_chars // (len(names) * fit_docs)))
    start = F.pmod(F.xxhash64("_draw", F.lit(6)), F.greatest(F.length("_whole") - most + 1, F.lit(1))).cast("int") + 1
    rows = rows.filter(F.col("lang").isin(names)).select(
        "lang", "_draw", F.substring("_whole", start, F.lit(most)).alias("_text")
    )
    order = Window.partitionBy("lang").orderBy("_draw", "_text")
    picked = rows.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= fit_docs)
    found: dict[str, list[tuple[int, str]]] = {}
    for row in picked.select("lang", "_rank", "_text").toLocalIterator():
        found.setdefault(row["lang"], []).append((row["_rank"], row["_text"]))
    return {name: "\n".join(t for _, t in sorted(texts)) for name, texts in sorted(found.items())}


class Alphabet:
    """Small codes for characters: 0 for anything but letters, then the letters of the training texts.

    Letters that no training text has share the last code but one; the last code fills up blocks.
    """

    def __init__(self, texts: list[str]) -> None:
        letters = sorted({c for t in texts for c in t.lower() if c.isalpha()})
        self.codes = {c: i + 1 for i, c in enumerate(letters)}
        self.other, self.fill, self.size = len(letters) + 1, len(letters) + 2, len(letters) + 3
        self.table = np.full(0x110000, -1, dtype=np.int32)
        for c, code in self.codes.items():
            self.table[ord(c)] = code

    def encode(self, text: str) -> np.ndarray:
        """Codes of a text in lower case; runs of other characters than letters become one 0."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
        codes = self.table[points]
        unseen = np.flatnonzero(codes < 0)
        if unseen.size:
            rare, where = np.unique(points[unseen], return_inverse=True)
            known = np.array([self.other if chr(p).isalpha() else 0 for p in rare.tolist()], dtype=np.int32)
            self.table[rare] = known  # each character is looked up once
            codes[unseen] = known[where]
        blank = codes == 0
        again = np.concatenate(([False], blank[1:] & blank[:-1])) if len(codes) else blank
        return codes[~again]


def suffix_automaton(codes: list[int], size: int) -> np.ndarray:
    """Transitions (state x symbol, -1 for none) of the suffix automaton of a sequence; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in codes:
        state = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and symbol not in moves[p]:
            moves[p][symbol] = state
            p = link[p]
        if p >= 0:
            q = moves[p][symbol]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(symbol) == q:
                    moves[p][symbol] = twin
                    p = link[p]
                link[q] = link[state] = twin
        last = state
    table = np.full((len(moves), size), -1, dtype=np.int32)
    for state, out in enumerate(moves):
        for symbol, to in out.items():
            table[state, symbol] = to
    return table


class Parser:
    """Counts phrases of texts against every language at once."""

    def __init__(self, texts: dict[str, str]) -> None:
        self.names = list(texts)
        self.alphabet = Alphabet(list(texts.values()))
        size = self.alphabet.size
        tables, starts, at = [], [], 0
        for text in texts.values():
            own = suffix_automaton(self.alphabet.encode(text).tolist(), size)
            # One state more, where a phrase of an unknown symbol has ended: nothing goes on from there.
            own = np.vstack([own, np.full((1, size), -1, dtype=np.int32)])
            own[:, self.alphabet.fill] = np.arange(len(own))
            tables.append(np.where(own >= 0, own + at, -1).astype(np.int32))
            starts.append((at, at + len(own) - 1))
            at += len(own)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, dtype=np.int32)
        self.starts = starts

    def phrases(self, codes: list[np.ndarray]) -> np.ndarray:
        """(texts x languages) numbers of phrases, each the longest that the training text has from there on."""
        size, fill = self.alphabet.size, self.alphabet.fill
        owner = np.repeat(np.arange(len(codes)), [-(-len(c) // BLOCK) for c in codes])
        cells = np.full((len(owner), BLOCK), fill, dtype=np.int32)
        row = 0
        for c in codes:
            for i in range(0, len(c), BLOCK):
                cells[row, : min(BLOCK, len(c) - i)] = c[i : i + BLOCK]
                row += 1
        out = np.zeros((len(codes), len(self.names)), dtype=np.int64)
        order = np.argsort(-(cells != fill).sum(axis=1), kind="stable")
        for low in range(0, len(order), 4096):
            lanes = order[low : low + 4096]
            steps = np.ascontiguousarray(cells[lanes].T)
            steps = steps[: int((steps != fill).any(axis=1).sum())]
            for k, (start, dead) in enumerate(self.starts):
                state = np.full(len(lanes), dead, dtype=np.int32)
                count = np.zeros(len(lanes), dtype=np.int32)
                first = self.table[start * size : (start + 1) * size].copy()
                first[first < 0] = dead
                for symbols in steps:
                    to = self.table[state * size + symbols]
                    ended = to < 0
                    count += ended
                    state = np.where(ended, first[symbols], to)
                np.add.at(out[:, k], owner[lanes], count)
        return out


@lru_cache(maxsize=2)
def _parser(names: tuple[str, ...], texts: tuple[str, ...]) -> Parser:
    return Parser(dict(zip(names, texts)))


def identify(
    docs: DataFrame, training: dict[str, str], modulus: int = 3, rest: int = 1, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``; whole texts, no shuffle.

    A text is parsed, block by block, into the fewest phrases that the training text of a language contains;
    the language with the fewest phrases per symbol wins (the first by name on a tie).  score is the winner's
    share of exp(-SHARPNESS * phrases / fewest phrases).  NULL texts and texts without a letter are
    ``und`` with score 0, as is everything if nothing was learned.  Repeated rows repeat; a NULL key is not
    held out.  Memory: one batch of text and the automata, which ``ALL_CHARS`` bounds.
    """
    names, learned = tuple(training), tuple(training.values())
    small_batches(docs.sparkSession)

    def predict(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        parser = _parser(names, learned)
        codes = [parser.alphabet.encode(t or "") for t in texts]
        counts = parser.phrases(codes).astype(np.float64)
        best = counts.argmin(axis=1)
        fewest = np.maximum(counts.min(axis=1), 1.0)
        odds = np.exp(-SHARPNESS * (counts / fewest[:, None] - 1.0))
        lettered = np.array([bool((c > 0).any()) for c in codes])
        score = np.where(lettered, odds.max(axis=1) / odds.sum(axis=1), 0.0)
        return [names[b] if ok else UNKNOWN for b, ok in zip(best, lettered)], score

    @F.pandas_udf("lang_pred string, score double")
    def parsed(column: pd.Series) -> pd.DataFrame:
        texts, langs, scores = column.tolist(), [], [np.zeros(0)]
        for a, b in batches(texts):
            lang, score = predict(texts[a:b]) if names else ([UNKNOWN] * (b - a), np.zeros(b - a))
            langs += lang
            scores.append(score)
        return pd.DataFrame({"lang_pred": pd.Series(langs, dtype=object), "score": np.concatenate(scores)})

    found = docs.select(F.col(key).alias("doc_id"), parsed(F.col(text)).alias("_found"))
    return found.select(
        "doc_id", held_out("doc_id", modulus, rest).alias("held_out"), F.col("_found.lang_pred"), F.col("_found.score")
    )
