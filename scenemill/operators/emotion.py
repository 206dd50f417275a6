"""Emotion scores of subtitle texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon, text


def emotion_scores(texts: DataFrame, text_col: str = "text", words_col: str | None = None) -> DataFrame:
    """Keyword, pattern, density and intensity scores of each text, their total and the matched words.

    ``words_col`` names a column of the text's words from any tokenizer: it lets one-character words count and
    gives the density; without it the density is the keyword score. Null and blank texts score 0 and match nothing.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    words = F.coalesce(F.col(words_col), F.array().cast("array<string>")) if words_col else None
    hits = [text.lexicon_hits(t, k, words) for k in (lexicon.CONFLICT, lexicon.CLIMAX, lexicon.INTENSE)]
    keyword = F.least(F.lit(1.0), (hits[0] * 1.0 + hits[1] * 0.8 + hits[2] * 0.6) / 3.0)
    blank = F.regexp_replace(t, r"(?U)\s+", "") == ""
    terms = {"conflict": lexicon.CONFLICT, "climax": lexicon.CLIMAX, "emotion": lexicon.INTENSE}
    several = {c: [k for k in ks if len(k) > 1] for c, ks in terms.items()}
    matched = text.matched_terms(t, several)
    if words is not None:
        single = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias("c")) for c, ks in terms.items() for k in ks if len(k) == 1])
        also = F.transform(F.filter(single, lambda s: F.array_contains(words, s["k"])), lambda s: F.concat(s["k"], F.lit("("), s["c"], F.lit(")")))
        matched = F.slice(F.concat(matched, also), 1, 10)
    out = texts.withColumns({"_blank": blank, "keyword_score": keyword, "pattern_score": text.pattern_score(t, lexicon.PATTERNS), "intensity_score": text.intensity_score(t), "matched": matched})
    density = text.density_score(words, lexicon.CONFLICT + lexicon.CLIMAX + lexicon.INTENSE) if words is not None else F.col("keyword_score")
    out = out.withColumn("density_score", density)
    parts = ["keyword_score", "pattern_score", "density_score", "intensity_score"]
    out = out.withColumns({c: F.when(F.col("_blank"), 0.0).otherwise(F.col(c)) for c in parts}).drop("_blank")
    return out.withColumn("emotion_score", text.emotion_total(*map(F.col, parts)))
