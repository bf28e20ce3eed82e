"""Quality rules: divergence of a document's histograms from those of its language.

Two histograms describe a text: its character classes, and the share of a few frequent
function words among all words.  The reference of a text is the sum over all other documents of its
language, drawn towards the nearest of the largest languages by the weight of PRIOR_WORDS words.  So
every text is judged, by one rule at every size of the table: a large language speaks for itself,
a rare one leans on the nearest, and a text without language, or alone in it, is compared with the nearest.
A text is rejected when the squared Jensen-Shannon distance (base 2) of either histogram to the reference exceeds
a limit, which grows with the distance that samples of these sizes are expected to have, so that
short texts and small references are judged too.

Null text counts as empty: no words, rejected by the minimum of words.  Where no document has words, nothing
diverges.  Repeated rows are judged alike; an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowintel.llm.text import LOWER, SPACE, Words, grams, slices, word_hash
from flowintel.session import checkpointed, join_per_key

# Frequent function words of English, French, German and Spanish.
COMMON_WORDS = (
    "the of and to a in is that it on was for with be as at by this are from an or not "
    "de la le et les des en un du une que est pour qui dans au par sur pas ne "
    "der die und den von zu das mit sich für auf ist im nicht dem ein eine "
    "el y los se del las por con no su es para al lo como"
).split()

# Character classes.  Bytes above 127 are letters outside ASCII.
CLASSES = ["lower", "upper", "digit", "blank", "point", "quote", "symbol", "other"]

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# Words of the nearest language in every reference, and the number of languages that can be the nearest.
PRIOR_WORDS = 2_000
LARGEST_LANGUAGES = 64
# A reference is as sure as so many independent words a document: words of one text are alike, and some texts are junk.
DOCUMENT_WORDS = 5
# A squared distance may reach the first value and the second times its expected sampling noise.
CLASS_LIMIT = (0.015, 5.0)
COMMON_LIMIT = (0.015, 2.75)


def _byte_classes() -> np.ndarray:
    table = np.full(256, CLASSES.index("other"), np.uint8)
    table[128:] = CLASSES.index("lower")
    table[SPACE.nonzero()] = CLASSES.index("blank")
    for name, chars in (("lower", "abcdefghijklmnopqrstuvwxyz"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
                        ("digit", "0123456789"), ("point", ".,;:!?"), ("quote", "\"'()-"),
                        ("symbol", "#*$%&|<>@[]{}+=/\\^_`~")):
        table[[ord(c) for c in chars]] = CLASSES.index(name)
    return table


BYTE_CLASS = _byte_classes()
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
FEATURES = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
            "classes array<bigint>, common array<bigint>")


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def repeated_words(words: Words, doc: np.ndarray, n: int = 3) -> np.ndarray:
    """Per word: whether a run of n words that covers it occurs again in the same text."""
    covered = np.zeros(len(words.hash), bool)
    if len(words.hash) < n:
        return covered
    inside = np.flatnonzero(doc[: 1 - n] == doc[n - 1 :])
    key = grams(words.hash, n)[inside]
    order = np.lexsort((key, doc[inside]))
    key, own = key[order], doc[inside][order]
    same = (key[1:] == key[:-1]) & (own[1:] == own[:-1])
    twice = np.zeros(len(key), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = inside[order[twice]]
    for i in range(n):
        covered[at + i] = True
    return covered


def text_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the text, the last column, by its counts and histograms."""
    hashes = np.array([word_hash(w) for w in COMMON_WORDS], np.uint64)
    order = np.argsort(hashes)
    known = hashes[order]
    bins, kinds = len(COMMON_WORDS) + 1, len(CLASSES)
    for batch in batches:
        parts = []
        for _, data, offsets in slices(batch.column(batch.num_columns - 1)):
            n = len(offsets) - 1
            row_of_byte = np.repeat(np.arange(n), np.diff(offsets))
            head = (data & 0xC0) != 0x80
            words = Words(data, offsets)
            doc = np.repeat(np.arange(n), words.counts())
            lower = Words(data, offsets, lower=True).hash
            slot = np.searchsorted(known, lower)
            slot[slot == len(known)] = 0
            word_bin = np.where(known[slot] == lower, order[slot], bins - 1)
            raw = data.tobytes()
            parts.append((
                words.counts(),
                np.bincount(row_of_byte[head & words.inside], minlength=n),
                np.bincount(row_of_byte[SYMBOL[data]], minlength=n),
                np.array([duplicate_lines(raw[offsets[i] : offsets[i + 1]]) for i in range(n)], np.int64),
                np.bincount(doc[repeated_words(words, doc)], minlength=n),
                np.bincount(row_of_byte[head] * kinds + BYTE_CLASS[data[head]], minlength=n * kinds),
                np.bincount(doc * bins + word_bin, minlength=n * bins),
            ))
        columns = [np.concatenate(x).astype(np.int64) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 7
        arrays = [pa.array(x) for x in columns[:5]]
        for flat, width in ((columns[5], kinds), (columns[6], bins)):
            arrays.append(pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, width, dtype=np.int32), pa.array(flat)))
        names = batch.schema.names[:-1] + [x.split()[0] for x in FEATURES.split(", ")]
        yield pa.RecordBatch.from_arrays(batch.columns[:-1] + arrays, names=names)


def js_squared(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Squared Jensen-Shannon distance of histograms along the last axis; 0 if one is empty."""
    total, base = counts.sum(axis=-1, keepdims=True), reference.sum(axis=-1, keepdims=True)
    p, q = counts / np.maximum(total, 1e-300), reference / np.maximum(base, 1e-300)
    middle = np.where(p + q > 0, (p + q) / 2, 1)
    terms = p * np.log2(np.where(p > 0, p / middle, 1)) + q * np.log2(np.where(q > 0, q / middle, 1))
    return np.where((total > 0) & (base > 0), np.maximum(terms.sum(axis=-1, keepdims=True) / 2, 0), 0)[..., 0]


def sampling_noise(reference: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Expected squared distance of a sample and a reference, `apart` being one over the sizes of both, added.

    A bin that a sample holds often adds (1 - q) / (8 n ln 2); one that it rarely holds adds q / 2, as when absent.
    """
    q = reference / np.maximum(reference.sum(axis=-1, keepdims=True), 1e-300)
    return np.minimum(q / 2, (1 - q) / (8 * math.log(2)) * apart[..., None]).sum(axis=-1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Histograms of a batch; a null one counts as empty."""
    out = np.zeros((len(column), width))
    there = ~column.is_null().to_numpy(zero_copy_only=False)
    out[there] = column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def verdicts(batch: pa.RecordBatch, largest: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """(class distance, common distance, base_failed, kept) of rows with their counts and language sums."""
    classes, common, all_classes, all_common = (
        _matrix(batch.column(batch.schema.get_field_index(c)), width)
        for c, width in (("classes", len(CLASSES)), ("common", len(COMMON_WORDS) + 1),
                         ("ref_classes", len(CLASSES)), ("ref_common", len(COMMON_WORDS) + 1)))
    words, repeats = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("n_words", "n_repeat_words"))
    texts = batch.column(batch.schema.get_field_index("ref_docs")).fill_null(0).to_numpy() - (words > 0)
    others = [np.maximum(all_classes - classes, 0), np.maximum(all_common - common, 0)]
    own_share = np.ones(len(words))
    apart = 1 / np.maximum(words, 1)
    if len(largest[0]):
        nearest = np.stack([js_squared(common, c) + js_squared(classes, k) for k, c, _ in zip(*largest)]).argmin(axis=0)
        own_words = others[1].sum(axis=1)
        # in characters the prior weighs as much as PRIOR_WORDS words of the nearest language
        weight = PRIOR_WORDS / np.maximum(largest[1].sum(axis=1), 1)
        for i in (0, 1):
            others[i] = others[i] + (largest[i] * weight[:, None])[nearest]
        own_share = own_words / (own_words + PRIOR_WORDS)
        apart = apart + (1 - own_share) ** 2 / (DOCUMENT_WORDS * largest[2][nearest])
    apart = apart + np.where(texts > 0, own_share**2 / (DOCUMENT_WORDS * np.maximum(texts, 1)), 0)
    squared = js_squared(classes, others[0]), js_squared(common, others[1])
    failed = (words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * words)
    kept = ~failed
    for distance, reference, limit in zip(squared, others, (CLASS_LIMIT, COMMON_LIMIT)):
        kept &= distance <= limit[0] + limit[1] * sampling_noise(reference, apart)
    return np.sqrt(squared[0]), np.sqrt(squared[1]), failed, kept


def quality_features(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """`keys`, the five counts and the two histograms of every row."""
    rows = docs.select(*keys, F.col(text_col).cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(text_features, f"{schema}, {FEATURES}")


def language_references(features: DataFrame, lang_col: str = "lang") -> DataFrame:
    """Summed histograms of each language and its number of texts with words: _lang, ref_classes, ref_common, ref_docs."""
    def summed(name: str) -> DataFrame:
        cells = features.where(F.col(lang_col).isNotNull()).select(lang_col, F.posexplode(name).alias("_i", "_n"))
        sums = cells.where("_n > 0").groupBy(lang_col, "_i").agg(F.sum("_n").alias("_n"))
        width = len(CLASSES) if name == "classes" else len(COMMON_WORDS) + 1
        cell = F.map_from_entries(F.collect_list(F.struct("_i", "_n")))
        cell_of = F.col("_cells")
        dense = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(cell_of[i], F.lit(0)))
        return sums.groupBy(lang_col).agg(cell.alias("_cells")).select(
            F.col(lang_col).alias("_lang"), dense.alias(f"ref_{name}"))

    texts = features.where(F.col(lang_col).isNotNull() & (F.col("n_words") > 0)).groupBy(F.col(lang_col).alias("_lang")).agg(
        F.count("*").alias("ref_docs"))
    return summed("classes").join(summed("common"), "_lang").join(texts, "_lang")


def largest_references(references: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class sums, common-word sums and numbers of texts of the LARGEST_LANGUAGES languages with most words (ties by name), for the driver to hand out."""
    words = F.aggregate("ref_common", F.lit(0).cast("bigint"), lambda a, x: a + x)
    rows = references.orderBy(words.desc(), "_lang").limit(LARGEST_LANGUAGES).select("ref_classes", "ref_common", "ref_docs").collect()
    return tuple(np.array([r[i] for r in rows], np.float64) for i in range(3))


def judge(docs: DataFrame, keys: list[str], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """`keys`, the counts, both distances, `base_failed` and `kept` of every row."""
    features = checkpointed(quality_features(docs.withColumn("_lang_key", F.col(lang_col)), [*keys, "_lang_key"], text_col))
    references = checkpointed(language_references(features, "_lang_key"))
    largest = largest_references(references)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            class_distance, common_distance, failed, kept = verdicts(batch, largest)
            shown = batch.columns[: len(keys) + len(counts)]
            yield pa.RecordBatch.from_arrays(
                [*shown, *map(pa.array, (failed, kept, class_distance, common_distance))],
                names=[*batch.schema.names[: len(shown)], "base_failed", "kept", "class_distance", "common_distance"])

    rows = join_per_key(features, references, F.col("_lang_key") == F.col("_lang")).select(
        *keys, *counts, "classes", "common", "ref_classes", "ref_common", "ref_docs")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keys) + len(counts)])
    return rows.mapInArrow(run, f"{schema}, base_failed boolean, kept boolean, class_distance double, common_distance double")


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows that the rules keep, with their columns.  The row travels beside its text, so no join brings it back."""
    own = F.col(lang_col).alias("_lang_key")
    references = checkpointed(language_references(checkpointed(quality_features(docs.select(own, text_col), ["_lang_key"], text_col)), "_lang_key"))
    largest = largest_references(references)
    packed = docs.select(F.struct(*docs.columns).alias("_row"), own, F.col(text_col).cast("string").alias("_own_text"))
    rows = join_per_key(packed, references, F.col("_lang_key") == F.col("_lang")).select(
        "_row", "ref_classes", "ref_common", "ref_docs", "_own_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_features(batches):
            kept = pa.array(verdicts(batch, largest)[3])
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept)], names=["_row"])

    kept = rows.mapInArrow(run, f"_row {rows.schema['_row'].dataType.simpleString()}")
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
