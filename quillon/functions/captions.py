"""Captions by rule from the statistics of an embedding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vectors as V
from .rules import feature_word

# The words and templates that captions are made of.
TEMPLATES = {
    "nature": [
        "This is a beautiful natural landscape with mountains and trees in the background.",
        "A serene nature scene with lush greenery and flowing water.",
        "An outdoor wilderness area with diverse plant life.",
        "A stunning view of natural terrain with various geological features.",
    ],
    "urban": [
        "This appears to be a cityscape with tall buildings and urban infrastructure.",
        "An urban environment with streets, buildings, and city elements.",
        "A metropolitan area with architectural structures and civic design.",
        "A city scene showing various buildings and urban development.",
    ],
    "person": [
        "The image shows a person engaged in some activity.",
        "A human figure appears in this image, possibly performing an action.",
        "There is a person visible in the scene, with certain distinguishing features.",
        "The image contains a human subject in a particular setting.",
    ],
    "object": [
        "The image depicts a common object or item in focus.",
        "This seems to be a close-up view of an object or item.",
        "The main subject is an object with specific characteristics.",
        "A clear view of what appears to be an everyday item or object.",
    ],
    "abstract": [
        "This appears to be an abstract image with various patterns and colors.",
        "The image contains abstract elements without a clear representational subject.",
        "A non-representational image with various visual elements and composition.",
        "An abstract composition featuring diverse visual properties and relationships.",
    ],
}
ANALYSES = [
    "Looking at the embedding values, this appears to be {category} content with {feature} characteristics.",
    "The embedding pattern suggests {category} content with emphasis on {feature} elements.",
    "Based on the embedding signature, this is likely a {category} image showing {feature} components.",
    "The distribution of values in this embedding is typical of {category} imagery with {feature} aspects.",
]
WORDS = {
    "low_variance": ["subtle", "minimal", "subdued", "restrained"],
    "high_variance": ["vibrant", "complex", "detailed", "intricate"],
    "positive_bias": ["bright", "colorful", "vivid", "energetic"],
    "negative_bias": ["dark", "muted", "somber", "understated"],
    "clustered": ["organized", "structured", "patterned", "regular"],
    "dispersed": ["diverse", "varied", "heterogeneous", "mixed"],
}
#: Words of a prompt, and what is added to the template if it has one of them; the first that fits counts.
DETAILS = [
    (("caption", "describe"), " The visual content appears to have {f1} and {f2} qualities."),
    (("main", "subject"), " The main subject shows characteristics of {f1} content with {f2} aspects."),
    (("happening", "scene"), " The scene depicts {category} elements with {f1} and {f3} attributes."),
]
DETAIL = " Analysis reveals {f1}, {f2}, and {f3} properties in the visual data."
#: A prompt with one of these words gets an analysis.
ANALYSED = ("embedding", "vector", "feature")


def _filled(template: Column | str, **values: Column) -> Column:
    out = F.lit(template) if isinstance(template, str) else template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def _picked(texts: list[str], key: Column, salt: str) -> Column:
    """One of the texts, by a hash of the key."""
    hashed = F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(salt))), 1, 4), 16, 10).cast("int")
    return F.element_at(F.array(*map(F.lit, texts)), F.pmod(hashed, F.lit(len(texts))) + 1)


def _has(prompt: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(F.lower(prompt), F.lit(w))
    return out


def caption(key: Column, v: Column | str, prompt: Column) -> Column:
    """The caption of an embedding for a prompt (null: empty). The key takes the place of chance in the choice of templates; an embedding
    with an element over 10 counts at length 1. Null for an embedding that is null or has fewer than two elements."""
    p = F.coalesce(prompt, F.lit(""))

    def said(s: Column) -> Column:
        mean, std, entropy = s["mean"], s["std"], s["entropy"]
        word = lambda test, yes, no, x: F.when(test, feature_word(x, WORDS[yes])).otherwise(feature_word(x, WORDS[no]))
        f1, f2 = word(std > 0.3, "high_variance", "low_variance", std * 10), word(mean > 0, "positive_bias", "negative_bias", F.abs(mean) * 10)
        f3 = word(entropy < 2.0, "clustered", "dispersed", entropy)
        plain = F.when(std > 0.3, F.when(mean > 0.1, "nature").otherwise("urban")).otherwise(F.when(mean > 0, "person").otherwise("object"))
        kind = F.when(entropy > 2.5, "abstract").otherwise(plain)
        base = F.coalesce(*[F.when(kind == k, _picked(texts, key, "")) for k, texts in TEMPLATES.items()])
        values = {"category": kind, "f1": f1, "f2": f2, "f3": f3}
        detail = _filled(DETAIL, **values)
        for words, text in reversed(DETAILS):
            detail = F.when(_has(p, words), _filled(text, **values)).otherwise(detail)
        analysis = _filled(_picked(ANALYSES, key, "a"), category=kind, feature=F.concat(f1, F.lit(", "), f2, F.lit(", and "), f3))
        return F.when(s.isNotNull(), F.when(_has(p, ANALYSED), analysis).otherwise(F.concat(base, detail)))

    stats = lambda x: F.struct(V.mean(x).alias("mean"), V.std(x, sample=True).alias("std"), V.entropy(x).alias("entropy"))
    sized = V.bound(V.normalize_if_large(v), lambda x: F.when(F.size(x) > 1, stats(x)))
    return V.bound(sized, said)
