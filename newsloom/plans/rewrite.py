"""Rewriting: who is eligible, the prompt, the answer, and what it changes."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import fixed_values as fixed
from newsloom.functions.basics import is_blank, or_default, strip_all_tags, trimmed
from newsloom.functions.text import word_count
from newsloom.operators.markup import media_placeholders, restore_media
from newsloom.plans.translate import Cache, TranslateFn, new_entries, offline_translate, translate_content
from newsloom.session import spread_for_calls, stage

# prompts -> raw answers; an exception or None marks a failed call
RewriteFn = Callable[[list[str]], list[str | None]]


def offline_rewrite(prompts: list[str]) -> list[str | None]:
    """A stand-in without any service: answers with the prompt's length, and not at all to every fifth length."""
    return [
        None if len(p) % 5 == 0 else json.dumps({"title": f"R{len(p)}", "meta_description": "M", "content": f"<p>{len(p)}</p>"})
        for p in prompts
    ]


ANSWER = "struct<title:string,meta_description:string,content:string>"


@dataclass(frozen=True)
class RewriteOptions:
    enabled: bool = True
    provider: str = "custom"
    has_key: bool = True
    tone: str = fixed.DEFAULT_TONE
    target_language: str = "pt-BR"
    min_words: int = 200
    max_words: int = 800
    preserve_media: bool = True

    @property
    def usable(self) -> bool:
        return self.enabled and self.provider != "none" and self.has_key


def prepare(df: DataFrame, column: str = "content", preserve_media: bool = True) -> DataFrame:
    """Add ``plain`` text, ``media`` and ``words``."""
    if preserve_media:
        df = media_placeholders(df, column, text="plain", media="media")
    else:
        df = df.withColumn("plain", strip_all_tags(column)).withColumn(
            "media", F.array().cast("array<struct<token:string,original:string>>")
        )
    return df.withColumn("words", word_count(strip_all_tags("plain")))


def eligibility(enabled, provider, has_key) -> Column:
    """Reason why a prepared text is not rewritten; null when it is."""
    usable = enabled & (provider != "none") & has_key
    return F.when(~usable, fixed.REWRITE_DISABLED_ERROR).when(
        (F.col("words") < fixed.REWRITE_MIN_WORDS) & (F.size("media") == 0), fixed.REWRITE_SHORT_ERROR
    )


def word_targets(words, min_words=200, max_words=800) -> tuple[Column, Column]:
    """Lower and upper word numbers asked for."""
    words = F.col(words) if isinstance(words, str) else words
    low = F.greatest(F.lit(min_words).cast("long"), F.round(words * F.lit(0.85).cast("double")).cast("long"))
    high = F.greatest(F.lit(max_words).cast("long"), F.round(words * F.lit(1.3).cast("double")).cast("long"))
    return low, high


def _chosen(key, table: dict[str, str], default: str) -> Column:
    key = key if isinstance(key, Column) else F.lit(key)
    out = F.lit(default)
    for name, text in table.items():
        out = F.when(key == name, text).otherwise(out)
    return out


def build_prompt(
    title, content, words, media_count, translate=False, tone=fixed.DEFAULT_TONE,
    language="pt-BR", min_words=200, max_words=800,
) -> Column:
    """The prompt text; unknown tones and languages fall back to the usual ones."""
    translate = translate if isinstance(translate, Column) else F.lit(bool(translate))
    low, high = word_targets(words, min_words, max_words)
    before, after = fixed.LANGUAGE_RULE.split("{language}")
    language_rule = F.concat(
        F.lit(before), _chosen(language, fixed.LANGUAGE_NAMES, fixed.DEFAULT_LANGUAGE_NAME), F.lit(after)
    )
    slots = {
        "tone": _chosen(tone, fixed.TONES, fixed.TONES[fixed.DEFAULT_TONE]),
        "language_rule": F.when(translate, language_rule).otherwise(""),
        "media_rule": F.when(media_count > 0, fixed.MEDIA_RULE).otherwise(""),
        "min_words": low.cast("string"),
        "max_words": high.cast("string"),
        "title": F.coalesce(title, F.lit("")),
        "content": F.coalesce(content, F.lit("")),
        "word_count": words.cast("string"),
        "media_count": media_count.cast("string"),
    }
    pieces = re.split(r"\{(\w+)\}", fixed.PROMPT_TEMPLATE)
    return F.concat(*[slots[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces)])


def parse_response(raw) -> Column:
    """Struct (answer, error) of a raw answer: code fence off, JSON read, else the JSON inside it."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    text = trimmed(raw)
    text = F.when(F.contains(text, F.lit("```json")), F.regexp_replace(text, r"^```json\s*|\s*```$", "")).otherwise(text)
    inner = F.regexp_extract(text, fixed.RESPONSE_OBJECT_PATTERN, 0)
    usable = F.when(F.try_parse_json(text).isNotNull(), text).when(F.try_parse_json(inner).isNotNull(), inner)
    return F.struct(
        F.from_json(usable, ANSWER).alias("answer"),
        F.when(is_blank(raw), fixed.REWRITE_EMPTY_ERROR).when(usable.isNull(), fixed.REWRITE_FORMAT_ERROR).alias("error"),
    )


def apply_rewrite(df: DataFrame, parsed: str = "parsed") -> DataFrame:
    """Non-blank answer fields replace the originals; media go back to their places."""
    answer = F.col(f"{parsed}.answer")
    ok = F.col(f"{parsed}.error").isNull()

    def pick(name: str, new: Column, old: Column) -> Column:
        return F.when(ok & ~is_blank(answer[name]), new).otherwise(old)

    content = restore_media(answer["content"], F.col("media")) if "media" in df.columns else answer["content"]
    return (
        df.withColumn("_title", pick("title", answer["title"], F.col("title")))
        .withColumn("_content", pick("content", content, F.col("content")))
        .withColumn("meta_description", pick("meta_description", answer["meta_description"], F.lit("")))
        .withColumn("title", F.col("_title")).withColumn("content", F.col("_content"))
        .drop("_title", "_content")
    )


def call_rewriter(prompts: DataFrame, fn: RewriteFn) -> DataFrame:
    """(row_key, prompt) -> (row_key, raw, call_error); a failed call is a row, not a failed job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["prompt"].tolist()
            try:
                raw, error = list(fn(texts)), [None] * len(texts)
            except Exception:
                raw, error = [], []
                for text in texts:   # find out which of them fails
                    try:
                        raw.append(fn([text])[0])
                        error.append(None)
                    except Exception as problem:
                        raw.append(None)
                        error.append(str(problem))
            yield pd.DataFrame({"row_key": batch["row_key"].tolist(), "raw": raw, "call_error": error}, dtype=object)

    calls = spread_for_calls(prompts.select("row_key", "prompt"), "row_key")
    return calls.mapInPandas(run, "row_key string, raw string, call_error string")


def rewrite_documents(
    docs: DataFrame, fn: RewriteFn, options: RewriteOptions = RewriteOptions()
) -> DataFrame:
    """Every distinct prompt is asked once.  Add ``rewritten``, ``rewrite_error`` and ``meta_description``; title and content changed where it worked."""
    translate = F.coalesce(F.col("translate"), F.lit(False)) if "translate" in docs.columns else F.lit(False)
    ready = prepare(docs, "content", options.preserve_media)
    ready = ready.withColumn(
        "_refused", eligibility(F.lit(options.enabled), F.lit(options.provider), F.lit(options.has_key))
    )
    prompt = build_prompt(
        F.col("title"), F.col("plain"), F.col("words"), F.size("media"), translate,
        options.tone, options.target_language, options.min_words, options.max_words,
    )
    # prepared once; a prompt is known by its hash, and rows with the same one share an answer
    known = F.when(F.col("_refused").isNull(), F.md5(prompt))
    ready = stage(ready.withColumns({"_prompt": known, "_row": F.monotonically_increasing_id()}), "prepared")
    askers = ready.where("_prompt IS NOT NULL").groupBy("_prompt").agg(F.min("_row").alias("_asker")).select("_asker")
    asked = ready.join(stage(askers, "askers"), F.col("_row") == F.col("_asker"), "left_semi")
    asked = asked.select(F.col("_prompt").alias("row_key"), prompt.alias("prompt"))
    answers = stage(call_rewriter(asked, fn), "rewrites")
    joined = ready.join(answers, F.col("_prompt") == F.col("row_key"), "left")
    joined = joined.withColumn("parsed", parse_response("raw"))
    error = F.coalesce(F.col("_refused"), F.col("call_error"), F.col("parsed.error"))
    out = apply_rewrite(joined).withColumn("rewrite_error", or_default(error, F.lit("")))
    return out.withColumn("rewritten", F.col("rewrite_error") == "").drop(
        "plain", "media", "words", "_prompt", "_row", "_refused", "row_key", "raw", "call_error", "parsed"
    )


@dataclass
class Rework:
    """The step of an import run that rewrites posts, and translates where that is off or failed.

    After the step ``entries`` holds the cache entries that the run has made, for the cache's keeper.
    """

    rewrite_fn: RewriteFn | None = None
    options: RewriteOptions = RewriteOptions()
    translate_fn: TranslateFn = offline_translate
    cache: Cache | None = None
    now: object = None
    source: str = "en"
    target: str = "pt"
    entries: DataFrame | None = None

    def __call__(self, winners: DataFrame) -> DataFrame:
        rows = winners
        for name, default in (("translate", False), ("meta_description", "")):
            if name not in rows.columns:
                rows = rows.withColumn(name, F.lit(default))
        if self.rewrite_fn is not None and self.options.usable:
            rows = rewrite_documents(rows.drop("meta_description"), self.rewrite_fn, self.options)
        else:
            rows = rows.withColumn("rewritten", F.lit(False))
        if self.cache is None:
            return rows
        asked = rows.withColumn("_wished", F.col("translate")).withColumn(
            "translate", F.col("translate") & ~F.col("rewritten")
        )
        out, made = translate_content(asked, self.cache, self.now, self.translate_fn, self.target, self.source, key="run_key")
        self.entries = new_entries(made, self.now)
        return out.withColumn("translate", F.col("_wished")).drop("_wished", "translated", "excerpt")


def rework(rewrite_fn: RewriteFn | None = None, options: RewriteOptions = RewriteOptions(), **how) -> Rework:
    return Rework(rewrite_fn, options, **how)
