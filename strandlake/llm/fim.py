"""Fill-in-middle transformation: documents cut into prefix, middle and suffix at token borders, in Arrow batches.

Where a text is cut and in which order its parts stand follows from the document's id and a seed alone, so reruns agree and
no document meets another: there is no shuffle. A text's token ends go into one compact array, and two look-ups in it slice the text.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

TOKEN = regex.compile(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++")
MARKERS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
CUT = "n long, form string, prefix_chars long, middle_chars long, output string"


def ends(text: str) -> array:
    """The offset behind each token of a text, in order."""
    return array("Q", (m.end() for m in TOKEN.finditer(text)))


def draws(key: str, seed: int) -> tuple[int, ...]:
    """Four unsigned 32-bit numbers from the SHA-256 of seed and document."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def cut(text: str, key: str, seed: int, rate: int, suffix_first: int, markers: tuple[str, str, str]) -> tuple[int, str, int | None, int | None, str]:
    at = ends(text)
    n = len(at)
    one, two, move, order = draws(key, seed)
    if not text or move % 100 >= rate or any(m in text for m in markers):
        return n, PLAIN, None, None, text
    low, high = sorted((one % (n + 1), two % (n + 1)))
    a, b = (at[k - 1] if k else 0 for k in (low, high))
    p, s, m = markers
    if order % 100 < suffix_first:
        return n, SPM, a, b - a, f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}"
    return n, PSM, a, b - a, f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}"


def rebuild(output: str, form: str, markers: tuple[str, str, str]) -> str:
    """The text that an output was made of. Markers occur in no transformed text and can't arise across a border, so the first of each is its own."""
    if form == PLAIN:
        return output
    first, second = (markers[0], markers[1]) if form == PSM else (markers[1], markers[0])
    left, rest = output[len(first) :].split(second, 1)
    right, middle = rest.split(markers[2], 1)
    prefix, suffix = (left, right) if form == PSM else (right, left)
    return prefix + middle + suffix


def cutting(seed: int, rate: int, suffix_first: int, markers: tuple[str, str, str]):
    @F.pandas_udf(CUT)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, keys in batches:
            rows = [cut(text, key, seed, rate, suffix_first, markers) for text, key in zip(texts, keys, strict=True)]
            yield pd.DataFrame({
                "n": [r[0] for r in rows], "form": [r[1] for r in rows], "prefix_chars": pd.array([r[2] for r in rows], "Int64"),
                "middle_chars": pd.array([r[3] for r in rows], "Int64"), "output": [r[4] for r in rows],
            })

    return run


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, suffix_first: int = 80, markers: tuple[str, str, str] = MARKERS, keep: tuple[str, ...] = ("doc_id",), name: str = "fim") -> DataFrame:
    """The columns `keep` and a struct `name` (n tokens, form, prefix_chars, middle_chars, output) for every row's whole text.

    `rate` of 100 documents are transformed, `suffix_first` of 100 of those with the suffix first (spm), the others with the prefix first (psm). A null text
    is an empty one; empty texts and texts that hold a marker stay as they are (plain, lengths null). A null doc_id draws like the empty string, and rows
    with one doc_id draw alike, so repeated rows get the same output. Very long texts cost eight bytes for each token beside themselves. Rows are
    independent, so there is nothing to tie or to skew; an empty table gives an empty one. Only `keep`, doc_id and text are read, whatever other columns are
    called; if `keep` holds `name` already, underscores are added to the struct's name.
    """
    fim = cutting(seed, rate, suffix_first, markers)(F.coalesce("text", F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return docs.select(*[F.col(f"`{c}`") for c in keep], fim.alias(fresh(name, keep)))


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text from output and form alone; null from null."""

    @F.pandas_udf("string")
    def run(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([None if o is None else rebuild(o, f, markers) for o, f in zip(outputs, forms, strict=True)], dtype=object)

    return run(output, form)


def digests(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """Struct of the SHA-256 (lowercase hex, UTF-8) of an output and of the text restored from it."""

    @F.pandas_udf("output_sha256 string, restored_sha256 string")
    def run(outputs: pd.Series, forms: pd.Series) -> pd.DataFrame:
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        return pd.DataFrame({"output_sha256": [digest(o) for o in outputs], "restored_sha256": [digest(rebuild(o, f, markers)) for o, f in zip(outputs, forms, strict=True)]})

    return run(output, form)


def report(docs: DataFrame) -> DataFrame:
    """One row for every document: doc_id, n, form, lengths, and the digests of output and restored text. Odd cases as in transform."""
    made = transform(docs)
    return made.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", digests(F.col("fim.output"), F.col("fim.form")).alias("d")).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "d.*")


#: The same in DuckDB.
SQL = r"""
WITH token AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t,
         sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS d
  FROM documents
), drawn AS (
  SELECT doc_id, text, t, len(t)::BIGINT AS n, ('0x' || d[1:8])::BIGINT % (len(t) + 1) AS x, ('0x' || d[9:16])::BIGINT % (len(t) + 1) AS y,
         ('0x' || d[17:24])::BIGINT % 100 AS move, ('0x' || d[25:32])::BIGINT % 100 AS side
  FROM token
), sliced AS (
  SELECT *, array_to_string(t[1:least(x, y)], '') AS p, array_to_string(t[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(t[greatest(x, y) + 1:], '') AS s,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR move >= 50 THEN 'plain'
              WHEN side < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(p || m || s) AS restored_sha256
FROM sliced
"""
