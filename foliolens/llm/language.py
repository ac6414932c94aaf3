"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. An n-gram is the
product of its letters' vectors, each rotated by its place; a text is the sum of its n-grams;
a language's prototype is the sum of its texts' unit vectors. Prediction is the prototype of
the highest cosine, after what all prototypes share is taken off.

Null or letterless texts give ``und`` and score 0, ties the first language by name, repeated
rows the same answer each, an empty table no rows; without any learned language all is
``und``. Other columns are ignored. A very long
text is one bundle of its n-grams, whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.llm.common import bounded_ids, map_texts

DIMENSIONS, GRAM = 1024, 3
#: At most so many labelled documents make the prototypes.
SAMPLE_ROWS = 20_000


class Profiler:
    """Unit vectors of texts; letters' vectors are made when first met."""

    def __init__(self, dimensions: int = DIMENSIONS, gram: int = GRAM, seed: int = 7):
        self.dimensions, self.gram, self.seed = dimensions, gram, seed
        self.letter = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)
        self.place = np.zeros(0x110000, np.int32)
        self.vectors = np.zeros((0, dimensions), np.float32)

    def letters(self, codes: np.ndarray) -> np.ndarray:
        """Row of each code point in ``vectors``."""
        new = [c for c in np.unique(codes) if not self.place[c]]
        if new:
            made = [np.random.default_rng([self.seed, int(c)]).integers(0, 2, self.dimensions) * 2 - 1 for c in new]
            self.place[new] = np.arange(len(new)) + len(self.vectors) + 1
            self.vectors = np.concatenate([self.vectors, np.array(made, np.float32)])
        return self.place[codes] - 1

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(matrix of unit vectors, whether the text has letters)."""
        out = np.zeros((len(texts), self.dimensions), np.float32)
        lettered = np.zeros(len(texts), bool)
        streams, owners = [], []
        for i, text in enumerate(texts):
            codes = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "replace"), np.uint32)
            is_letter = self.letter[codes]
            lettered[i] = is_letter.any()
            # Runs of anything else become one blank.
            keep = is_letter.copy()
            keep[1:] |= is_letter[:-1]
            keep[0] = True
            streams.append(np.where(is_letter, codes, 32)[keep])
            owners.append(np.full(len(streams[-1]), i, np.int64))
        codes, owner = np.concatenate(streams), np.concatenate(owners)
        whole = owner[self.gram - 1:] == owner[:len(owner) - self.gram + 1]
        grams = np.zeros(len(whole), np.uint64)
        for j in range(self.gram):
            grams = (grams << np.uint64(21)) | codes[j:len(codes) - self.gram + 1 + j].astype(np.uint64)
        kinds, which = np.unique(grams[whole], return_inverse=True)
        owner = owner[self.gram - 1:][whole]
        # A few thousand kinds at a time bound the memory for any alphabet.
        for start in range(0, len(kinds), 8192):
            part = kinds[start:start + 8192]
            bound = np.ones((len(part), self.dimensions), np.float32)
            for j in range(self.gram):
                code = ((part >> np.uint64(21 * (self.gram - 1 - j))) & np.uint64((1 << 21) - 1)).astype(np.int64)
                rows = self.letters(code)
                bound *= np.roll(self.vectors, self.gram - 1 - j, axis=1)[rows]
            mine = (which >= start) & (which < start + len(part))
            counts = np.bincount(owner[mine] * len(part) + which[mine] - start, minlength=len(texts) * len(part))
            out += counts.reshape(len(texts), len(part)).astype(np.float32) @ bound
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1), lettered


def prototypes(labelled: DataFrame, bound: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text",
               lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages by name and their unit vectors, from at most ``bound`` ids of ``labelled``."""
    def make(batches):
        profile, sums = Profiler(), {}
        for batch in batches:
            vectors, lettered = profile(batch.column(0).to_pylist())
            for vector, ok, lang in zip(vectors, lettered, batch.column(1).to_pylist()):
                if ok:
                    sums[lang] = sums.get(lang, 0) + vector
        for lang, vector in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(vector)), pa.array(range(len(vector)), pa.int32()),
                 pa.array(vector, pa.float64())], ["lang", "i", "v"])
    known = labelled.where(F.col(lang_col).isNotNull())
    chosen = known.join(F.broadcast(bounded_ids(known, id_col, bound, "language")), id_col, "left_semi")
    sums = (map_texts(chosen, [text_col, lang_col], make, "lang string, i int, v double")
            .groupBy("lang", "i").agg(F.round(F.sum("v"), 6).alias("v")).collect())
    langs = sorted({r["lang"] for r in sums})
    matrix = np.zeros((len(langs), DIMENSIONS), np.float32)
    for r in sums:
        matrix[langs.index(r["lang"]), r["i"]] = r["v"]
    return langs, matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)


def predict(docs: DataFrame, langs: list[str], matrix: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
            keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score): score is the cosine with the chosen prototype, 0 if negative."""
    common = matrix.mean(axis=0) if len(langs) > 1 else np.zeros(matrix.shape[1], np.float32)
    own = matrix - common
    own = own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)

    def make(batches):
        profile = Profiler()
        for batch in batches:
            vectors, lettered = profile(batch.column(1).to_pylist())
            if len(langs):
                best = np.argmax((vectors - common) @ own.T, axis=1)
                score = np.clip((vectors * matrix[best]).sum(axis=1), 0, 1)
                names = [langs[b] if ok else "und" for b, ok in zip(best, lettered)]
            else:
                score, names = np.zeros(batch.num_rows), ["und"] * batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(names, pa.string()),
                 pa.array(np.where(lettered, score, 0).astype(np.float64))], ["doc_id", "lang_pred", "score"])
    return map_texts(docs, [id_col, text_col], make, "doc_id long, lang_pred string, score double")
