"""Fill-in-middle texts by Spark SQL functions alone.

A text is cut into units, words with the white space before them; two places chosen
by the digest of the document's id part it into prefix, middle and suffix, and the
parts are put together again with sentinels, so that a model learns to write a
middle from both sides. The sentinels tell the parts, so the text can be restored.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citescan.llm.names import free

#: a word with the white space before it, or white space at the end
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: new columns
OUT = ("n_units", "form", "output", "prefix_chars", "middle_chars")


@dataclasses.dataclass(frozen=True)
class Options:
    """Sentinels before prefix, suffix and middle, the seed, and shares in hundredths: of cut texts, and of spm among them."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    seed: str = "42"
    rate: int = 50
    spm: int = 80

    def __post_init__(self):
        for s in (self.prefix, self.suffix, self.middle):
            if len(s) < 3 or s[0] != "<" or s[-1] != ">" or set(s[1:-1]) & {"<", ">"}:
                raise ValueError("a sentinel is <, some characters other than < and >, and >")
        if len({self.prefix, self.suffix, self.middle}) < 3:
            raise ValueError("sentinels: three different ones")


def draws(doc_id: Column, seed: str) -> list[Column]:
    """Four numbers of 32 bits from the sha256 of the seed, a colon and the id; a null id is empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """``docs`` without its text, with n_units, form, output, prefix_chars and middle_chars (code points).

    ``form`` is plain (the text as it is), psm (prefix, suffix, middle) or spm
    (suffix, prefix, middle). A null text is empty, and an empty text and one that
    holds a sentinel stay plain; the character counts of plain texts are null. Rows that share
    doc_id and text have equal outputs; ids that are null count as empty. Other
    columns stay; columns that have the names of new ones are replaced. An empty
    table gives an empty result.
    """
    text, units, h, n, lo, hi, form, parts = free(docs, "text", "units", "h", "n", "lo", "hi", "form", "parts")
    o = options
    rows = docs.withColumns({text: F.coalesce("text", F.lit("")), h: F.array(*draws(F.col("doc_id"), o.seed))})
    rows = rows.withColumn(units, F.regexp_extract_all(F.col(text), F.lit(UNIT), F.lit(0)))
    rows = rows.withColumn(n, F.size(units))
    draw = lambda i: F.get(h, i)
    first, second = draw(0) % (F.col(n) + 1), draw(1) % (F.col(n) + 1)
    holds = F.contains(F.col(text), F.lit(o.prefix)) | F.contains(F.col(text), F.lit(o.suffix)) | F.contains(F.col(text), F.lit(o.middle))
    named = F.when((F.col(text) == "") | holds | (draw(2) % 100 >= o.rate), PLAIN).when(draw(3) % 100 < o.spm, SPM).otherwise(PSM)
    rows = rows.withColumns({lo: F.least(first, second).cast("int"), hi: F.greatest(first, second).cast("int"), form: named})
    part = lambda a, b: F.array_join(F.slice(units, a + 1, b - a), "")
    cut = F.struct(part(F.lit(0), F.col(lo)).alias("p"), part(F.col(lo), F.col(hi)).alias("m"), part(F.col(hi), F.col(n)).alias("s"))
    rows = rows.withColumn(parts, F.when(F.col(form) != PLAIN, cut))
    p, m, s = (F.col(f"{parts}.{x}") for x in "pms")
    said = {o.prefix: p, o.suffix: s, o.middle: m}
    joined = lambda *order: F.concat(*[x for k in order for x in (F.lit(k), said[k])])
    output = F.when(F.col(form) == PSM, joined(o.prefix, o.suffix, o.middle)).when(F.col(form) == SPM, joined(o.suffix, o.prefix, o.middle)).otherwise(F.col(text))
    new = [F.col(n).cast("long"), F.col(form), output, F.length(p).cast("long"), F.length(m).cast("long")]
    return rows.select(*[c for c in docs.columns if c.lower() not in ("text", *OUT)], *[c.alias(name) for c, name in zip(new, OUT, strict=True)])


def restored(output: Column, form: Column, options: Options = Options()) -> Column:
    """The text that ``output`` was made from: its sentinels parted, its parts put in order.

    No sentinel can begin inside another or inside a part, so each is found where it was put.
    """
    o = options
    between = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    middle = F.substring_index(output, o.middle, -1)
    psm = F.concat(between(o.prefix, o.suffix), middle, between(o.suffix, o.middle))
    spm = F.concat(between(o.prefix, o.middle), middle, between(o.suffix, o.prefix))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)
