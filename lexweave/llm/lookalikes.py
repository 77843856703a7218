"""Text of one consistent form: width, compatibility forms, marks, invisible characters and look-alike letters."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.codes import code_points, slices
from lexweave.session import materialize

# fixed values: letters that look like Latin ones, in the order of their alphabets
CYRILLIC = ("АВЕЅІЈКМНОРСТУХԌԚԜ" "аеѕіјорсухһԁԛԝѵ", "ABESIJKMHOPCTYXGQW" "aesijopcyxhdqwv")
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "αγικνορτυχ", "ABEZHIKMNOPTYX" "ayikvoptux")
ARMENIAN = ("ՍՕ" "ոսօհց", "UO" "nuohg")
LATIN_OF = {a: b for foreign, latin in (CYRILLIC, GREEK, ARMENIAN) for a, b in zip(foreign, latin)}
FOREIGN_OF = {"CYRILLIC": {b: a for a, b in zip(*CYRILLIC)}, "GREEK": {b: a for a, b in zip(*GREEK)}, "ARMENIAN": {b: a for a, b in zip(*ARMENIAN)}}

_TAGS = {"<font>", "<wide>", "<narrow>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>"}
_JOINERS = re.compile("(?<=[\u0600-\u0dff])[\u200c\u200d](?=[\u0600-\u0dff])|(?<=[☀-➿\U0001F300-\U0001FAFF\ufe0f])\u200d")
WORDS = "[a-zß-öø-ɏḀ-ỿ]{2,}|[Ѐ-ԯ]{2,}|[Ͱ-Ͽἀ-῿]{2,}|[԰-֏]{2,}"
_WORD = re.compile(r"[^\W\d_]+")


@functools.cache
def _plain(c: str) -> str:
    """The ordinary characters of one compatibility form, or the character itself."""
    if ord(c) < 0x100:
        return c
    parts = unicodedata.decomposition(c).split()
    if not parts or (parts[0][0] == "<" and parts[0] not in _TAGS) or (parts[0][0] != "<" and len(parts) > 1):
        return c
    plain = unicodedata.normalize("NFKC", c)
    return plain if all(x.isalnum() or unicodedata.category(x)[0] == "M" for x in plain) else c


@functools.cache
def _class(c: str) -> str:
    """What a character needs: nothing, or the name of the repair."""
    o = ord(c)
    if unicodedata.category(c) == "Cf" and o not in range(0x600, 0x606) and o not in range(0xE0000, 0xE0080) or 0xFE00 <= o <= 0xFE0F:
        return "invisible"
    if c not in " \u3000" and unicodedata.category(c) == "Zs":
        return "space"
    if 0xFF10 <= o <= 0xFF19 or 0xFF21 <= o <= 0xFF3A or 0xFF41 <= o <= 0xFF5A:
        return "width"
    return "compatibility" if _plain(c) != c else ""


@functools.cache
def _script(c: str) -> str:
    return unicodedata.name(c, "").split(" ")[0]


@functools.cache
def _suspects() -> np.ndarray:
    """Per code point of the first plane, and once for all beyond it, whether it may need a repair."""
    out = np.zeros(0x10001, dtype=bool)
    for o in range(0x80, 0x10000):
        c = chr(o)
        foreign = 0x370 <= o < 0x590 or 0x1F00 <= o < 0x2000
        out[o] = foreign or 0x300 <= o < 0x370 or o in (0x3099, 0x309A) or not 0xD800 <= o < 0xE000 and _class(c) != ""
    out[0x10000] = True
    return out


def suspect_rows(column: pa.Array) -> np.ndarray:
    """Which texts hold a character that may need a repair; all others are in the consistent form."""
    codes, starts = code_points(column)
    hits = np.concatenate(([0], np.cumsum(_suspects()[np.minimum(codes, 0x10000)])))
    return hits[starts[1:]] > hits[starts[:-1]]


def fold(text: str) -> tuple[str, list[str]]:
    """The text without foreign widths, forms, marks and invisible characters, and the repairs it needed.

    Joiners between Arabic or Indic letters and in pictographs are spelling and stay.
    """
    keep = {m.start() for m in _JOINERS.finditer(text)} if "\u200c" in text or "\u200d" in text else ()
    out, repairs = [], set()
    for k, c in enumerate(text):
        what = _class(c) if ord(c) >= 0x80 else ""
        if not what or k in keep:
            out.append(c)
            continue
        repairs.add(what)
        if what == "space":
            out.append(" ")
        elif what != "invisible":
            out.append(_plain(c))
    folded = "".join(out)
    if re.search("(?<=[^\\W\\d_])[\u0300-\u036f\u3099\u309a]", folded):
        composed = unicodedata.normalize("NFC", folded)
        if composed != folded or re.search("[a-zA-Z][\u0300-\u036f]", folded):
            repairs.add("marks")
        folded = composed
    return folded, sorted(repairs)


def respell(word: str) -> str | None:
    """A mixed-script word in its dominant script, or null where it is not mixed or holds a letter without a look-alike.

    Latin is dominant where it has as many letters as the rest, or where all the rest are look-alikes of Latin letters
    and the word holds none that are of the other script alone.
    """
    scripts = [_script(c) for c in word]
    latin = scripts.count("LATIN")
    if not latin or latin == len(word) or set(scripts) - {"LATIN", *FOREIGN_OF}:
        return None
    if all(c in LATIN_OF for c, s in zip(word, scripts) if s != "LATIN"):
        return "".join(LATIN_OF.get(c, c) if s != "LATIN" else c for c, s in zip(word, scripts))
    others = {s for s in scripts if s != "LATIN"}
    if len(others) == 1 and latin < len(word) - latin:
        to = FOREIGN_OF[others.pop()]
        if all(c in to for c, s in zip(word, scripts) if s == "LATIN"):
            return "".join(to.get(c, c) if s == "LATIN" else c for c, s in zip(word, scripts))
    return None


def _fold_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.take(pa.array(np.flatnonzero(suspect_rows(b.column("text"))))) for whole in batches for b in slices(whole, "text")):
        texts, repairs, words = [], [], []
        for text in batch.column("text").to_pylist():
            folded, needed = fold(text)
            mixed = {w: r for w in set(_WORD.findall(folded)) if not w.isascii() and (r := respell(w))}
            texts.append(folded)
            repairs.append(needed)
            words.append([{"word": w, "spelling": r} for w, r in sorted(mixed.items())])
        kind = pa.list_(pa.struct([("word", pa.string()), ("spelling", pa.string())]))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("item_kind", "item_id", "digest", "text")), pa.array(texts, pa.string()), pa.array(repairs, pa.list_(pa.string())), pa.array(words, kind)], ["item_kind", "item_id", "digest", "text", "folded", "repairs", "mixed"])


def _plain_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b for whole in batches for b in slices(whole, "text")):
        yield batch.take(pa.array(np.flatnonzero(~suspect_rows(batch.column("text")))))


def _substitute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, known in zip(batch.column("folded").to_pylist(), batch.column("known").to_pylist()):
            spelling = {x["word"]: x["spelling"] for x in known or ()}
            texts.append(_WORD.sub(lambda m: spelling.get(m.group(), m.group()), text) if spelling else text)
        rest = ("repairs", "n_mixed", "n_respelt")
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("item_kind", "item_id", "text")), pa.array(texts, pa.string()), *(batch.column(c) for c in rest)], ["item_kind", "item_id", "text", "consistent", *rest])


def words_of(text: Column) -> Column:
    """Lower-case words of one script, as the vocabulary holds them."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def _rows(items: DataFrame) -> DataFrame:
    return items.select(F.col("item_kind").cast("string"), F.col("item_id").cast("string"), "text").filter(F.col("text").isNotNull())


def suspect_texts(items: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The part of ``consistent_texts`` whose texts hold a character that may need a repair.

    A table over the code points finds them; they are folded once and written to the shared folder, for the candidate spellings and
    the result both read them. The vocabulary is reduced to its distinct words before it meets the candidates.
    """
    key = ["item_kind", "item_id", "digest"]
    word = "array<struct<word:string,spelling:string>>"
    hashed = _rows(items).withColumn("digest", F.xxhash64("text"))
    folded = materialize(hashed.mapInArrow(_fold_rows, f"item_kind string, item_id string, digest long, text string, folded string, repairs array<string>, mixed {word}").dropDuplicates(key))
    candidates = folded.select(*[F.col(k).alias(f"k_{k}") for k in key], F.explode("mixed").alias("m")).withColumn("w", F.lower("m.spelling"))
    known = vocabulary.filter(F.col("text").isNotNull()).select(F.explode(words_of(F.col("text"))).alias("w")).distinct().join(candidates.select("w").distinct(), "w", "left_semi")
    spelt = candidates.join(known, "w").groupBy(*[f"k_{k}" for k in key]).agg(F.collect_list("m").alias("known"))
    same = [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in key]
    joined = folded.join(spelt, same, "left").select("item_kind", "item_id", "text", "folded", "repairs", F.size("mixed").alias("n_mixed"), F.when(F.col("known").isNull(), 0).otherwise(F.size("known")).alias("n_respelt"), "known")
    return joined.mapInArrow(_substitute, "item_kind string, item_id string, text string, consistent string, repairs array<string>, n_mixed int, n_respelt int")


def consistent_texts(items: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Each (item_kind, item_id, text) in one consistent form.

    ``items``: item_kind, item_id, text; ``vocabulary``: a ``text`` column whose words are known spellings. Returns the
    keys, ``text`` as it was, ``consistent``, ``repairs`` (width, compatibility, marks, invisible, space), ``n_mixed``
    words of mixed script that a look-alike spelling resolves, and ``n_respelt`` of them whose spelling the vocabulary
    holds, which alone are replaced. Null texts are left out, empty ones are consistent, and repeated rows of a text
    that holds a suspect character come out once, others as often as they came.
    """
    plain = _rows(items).mapInArrow(_plain_rows, "item_kind string, item_id string, text string").select("item_kind", "item_id", "text", F.col("text").alias("consistent"), F.array().cast("array<string>").alias("repairs"), F.lit(0).alias("n_mixed"), F.lit(0).alias("n_respelt"))
    return suspect_texts(items, vocabulary).unionByName(plain)


def needed_repair() -> Column:
    """True for a row of ``consistent_texts`` whose text was not in the consistent form."""
    return (F.size("repairs") > 0) | (F.col("n_mixed") > 0)
