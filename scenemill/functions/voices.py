"""Names of voices and the engines that speak them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes of names that belong to one engine, and the engines by name.
PREFIXES = {"soulvoice": "soulvoice:", "tencent": "tencent:", "qwen3": "qwen3:", "indextts2": "indextts2:", "cosyvoice": "cosyvoice:"}
ENGINES = {"tencent_tts": "tencent", "qwen3_tts": "qwen3", "soulvoice": "soulvoice", "edge_tts": "edge", "indextts2": "indextts2", "cosyvoice": "cosyvoice"}


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def plain_name(name: Column) -> Column:
    """A listed voice without its gender."""
    return _strip(F.replace(F.replace(name, F.lit("-Female")), F.lit("-Male")))


def second_form(name: Column) -> Column:
    """A voice of the second service without its mark ``-V2``; empty for others."""
    n = plain_name(name)
    return F.when(n.endswith("-V2"), _strip(F.replace(n, F.lit("-V2")))).otherwise("")


def belongs_to(name: Column, engine: str) -> Column:
    """Whether a voice carries an engine's prefix (``speech:`` is one of the first engine's, too)."""
    return name.startswith(PREFIXES[engine]) | (name.startswith("speech:") if engine == "soulvoice" else F.lit(False))


def without_prefix(name: Column, engine: str) -> Column:
    """A voice as its engine knows it; one without the prefix stays. The last engine's names are trimmed and empty ones null."""
    p = PREFIXES[engine]
    out = F.when(name.startswith(p), F.substring(name, F.lit(len(p) + 1), F.length(name))).otherwise(name)
    return F.when(F.coalesce(name, F.lit("")) != "", _strip(out)) if engine == "cosyvoice" else out


def wants_service(name: Column) -> Column:
    """Whether a voice is one of the speech service: by its mark, or by the form language-REGION-NameNeural."""
    n = _strip(name)
    form = n.rlike(r"(?U)^[a-z]{2}-[A-Z]{2}-\w+Neural$")
    return F.coalesce((name != "") & ~belongs_to(name, "soulvoice") & (n.endswith("-V2") | form), F.lit(False))


def engine_for(engine: Column, name: Column) -> Column:
    """P25: who speaks: the engine asked for; the speech service for its voices only, else the free one, which unknown engines get, too."""
    out = F.when(engine == "azure_speech", F.when(wants_service(name), "azure_v2").otherwise("edge"))
    for asked, kind in ENGINES.items():
        out = out.when(engine == asked, kind)
    return out.otherwise("edge")
