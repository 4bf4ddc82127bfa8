"""Understanding of raw queries: phrases, operators, time windows, cues and the words that are left to search for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.text import tokenize

# Words that are not searched for.
STOPWORDS = (
    "a an the and or but if then else of to in on at by for with from as is are was were be been being this that these those "
    "it its into over under about after before between during through up down out off again further once here there when "
    "where why how all any both each few more most other some such no nor not only own same so than too very can will just "
    "should now you your yours we our ours they them their he she his her i me my mine what which who whom whose have has had "
    "do does did done also like get got make made one thing things stuff something someone anything everything saved save "
    "kept keep keeping remember remembered find show tell give looking look want wanted need needed please something "
    "somewhere ago last recent recently lately earlier"
).split()

# Cue words by what they ask for, and words that narrow the cue after them.
TYPE_CUES = {
    "url": "website websites site page webpage link links url repo repos repository repositories github video videos youtube",
    "pdf": "pdf pdfs",
    "image": "screenshot screenshots image images picture pictures photo photos pic",
    "video": "video videos youtube",
    "folder": "folder folders directory",
    "note": "note notes",
}
SUBTYPE_CUES = {
    "github_repo": "repo repos repository repositories github",
    "screenshot": "screenshot screenshots",
    "youtube": "video videos youtube",
    "tweet": "tweet",
}
KIND_CUES = {
    "macos_app": "app apps application tool tools",
    "cli_tool": "app apps application tool tools",
    "saas_product": "app apps application tool tools",
    "video": "video videos youtube talk",
    "note": "note notes",
    "paper": "paper papers",
    "article": "article articles blog post",
    "docs": "docs documentation",
    "receipt": "receipt receipts invoice",
    "social_post": "post tweet thread",
}
MODIFIERS = ("mac", "macos")
ITEM_TYPES = ("file", "folder", "image", "video", "audio", "pdf", "text", "markdown", "url", "note", "unknown")

# Time phrases with the days since and until, first match wins; n is the number in the phrase.
TIME_PHRASES = (
    (r"\btoday\b", "1", None),
    (r"\byesterday\b", "2", None),
    (r"\bthis week\b", "7", None),
    (r"\b(?:last|past) week\b", "14", None),
    (r"\bthis month\b", "31", None),
    (r"\b(?:last|past) month\b", "45", None),
    (r"\b(?:last|past) year\b", "400", None),
    (r"\b(?:a )?(?:few|couple(?: of)?) (?:of )?weeks ago\b", "35", "10"),
    (r"\b(?:a )?(?:few|couple(?: of)?) (?:of )?days ago\b", "10", "1"),
    (r"\b(?:a )?(?:few|couple(?: of)?) (?:of )?months ago\b", "120", "45"),
    (r"\b(?:a|one) week ago\b", "12", "4"),
    (r"\b(?:a|one) month ago\b", "45", "18"),
    (r"\b(\d{1,3}) days? ago\b", "n + 2", "n - 2"),
    (r"\b(\d{1,2}) weeks? ago\b", "7 * n + 5", "7 * n - 5"),
    (r"\b(\d{1,2}) months? ago\b", "30 * n + 15", "30 * n - 15"),
    (r"\brecently\b|\blately\b|\bthe other day\b", "21", None),
)
DAY = 86_400
_OPERATOR = r"(?i)\b(type|kind|since|until|domain):(\S+)"


def time_window(lower: Column) -> Column:
    """``label, since_days, until_days`` of the first time phrase of the list that occurs; nulls without one."""
    out = F.struct(F.lit(None).cast("string").alias("label"), F.lit(None).cast("int").alias("since_days"), F.lit(None).cast("int").alias("until_days"))
    for pattern, since, until in reversed(TIME_PHRASES):
        n = F.coalesce(F.regexp_extract(lower, pattern, 1).try_cast("int"), F.lit(0)) if "(\\d" in pattern else F.lit(0)

        def days(rule: str | None, n: Column = n) -> Column:
            if rule is None:
                return F.lit(None).cast("int")
            if "n" not in rule:
                return F.lit(int(rule))
            factor = int(rule.split(" * ")[0]) if "*" in rule else 1
            sign, extra = rule.rsplit(" ", 2)[1:]
            return n * factor + int(extra) * (1 if sign == "+" else -1)

        bound = days(until)
        found = F.struct(F.regexp_extract(lower, pattern, 0).alias("label"), days(since).cast("int").alias("since_days"), F.when(bound > 0, bound).cast("int").alias("until_days"))
        out = F.when(lower.rlike(pattern), found).otherwise(out)
    return out


def _named(words: Column, table: dict[str, str], known: Column) -> Column:
    """The names of ``table`` whose words occur among ``words``, in the order of ``known``."""
    return F.filter(known, lambda k: F.exists(words, lambda w: F.array_contains(F.element_at(F.create_map(*[x for n, ws in table.items() for x in (F.lit(n), F.array(*map(F.lit, ws.split())))]), k), w)))


def understand_queries(raw: DataFrame, now: int) -> DataFrame:
    """For ``query_id, raw``: ``tokens`` (distinct, no stopwords, no cues), ``phrases``, ``cue_tokens``, ``types``,
    ``subtypes``, ``kinds``, ``domains``, ``strict``, ``note_cue``, ``since``, ``until`` (epoch seconds),
    ``time_label`` (the words of the time phrase) and ``embed_text``. ``now`` is given, in epoch seconds."""
    trimmed = F.trim(F.coalesce("raw", F.lit("")))
    df = raw.select("query_id", "raw", F.regexp_extract_all(trimmed, F.lit('"([^"]+)"'), F.lit(1)).alias("quoted"), F.regexp_replace(trimmed, '"([^"]+)"', " ").alias("t"))
    df = df.withColumn("ops", F.transform(F.regexp_extract_all("t", F.lit(_OPERATOR), F.lit(0)), lambda o: F.struct(F.lower(F.substring_index(o, ":", 1)).alias("key"), F.lower(F.regexp_replace(o, r"^[^:]*:", "")).alias("value"))))
    df = df.withColumn("t", F.regexp_replace("t", _OPERATOR, " "))
    of = lambda key: F.transform(F.filter("ops", lambda o: o["key"] == key), lambda o: o["value"])

    def at(value: Column) -> Column:
        unit = F.element_at(F.create_map(F.lit("d"), F.lit(1), F.lit("w"), F.lit(7), F.lit("m"), F.lit(30), F.lit("y"), F.lit(365)), F.regexp_extract(value, r"^\d{1,4}([dwmy])$", 1))
        ago = F.lit(now) - F.regexp_extract(value, r"^(\d{1,4})[dwmy]$", 1).try_cast("long") * unit * DAY
        return F.coalesce(ago, F.unix_timestamp(F.to_timestamp(F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), value), "yyyy-MM-dd")))

    last = lambda key: F.try_element_at(of(key), F.lit(-1))
    given = last("since").isNotNull() | last("until").isNotNull()
    df = df.withColumn("w", F.when(~given, time_window(F.lower("t"))))
    df = df.withColumns({"since": F.coalesce(at(last("since")), F.lit(now) - F.col("w.since_days").cast("long") * DAY), "until": F.coalesce(at(last("until")), F.lit(now) - F.col("w.until_days").cast("long") * DAY)})
    df = df.withColumn("t", F.when(F.col("w.label").isNotNull(), F.expr("replace(lower(t), w.label, ' ')")).otherwise(F.col("t")))
    cues = sorted({w for table in (TYPE_CUES, SUBTYPE_CUES, KIND_CUES) for ws in table.values() for w in ws.split()})
    cue_list, mods, stop = (F.array(*map(F.lit, x)) for x in (cues, MODIFIERS, STOPWORDS))
    df = df.withColumn("words", tokenize(F.col("t")))
    is_cue = lambda w: F.array_contains(cue_list, w)
    next_is_cue = lambda i: F.coalesce(is_cue(F.get("words", i + 1)), F.lit(False))
    cued = F.filter("words", lambda w, i: is_cue(w) | (F.array_contains(mods, w) & next_is_cue(i)))
    df = df.withColumn("cue_tokens", cued)
    tokens = F.array_distinct(F.filter("words", lambda w, i: ~is_cue(w) & ~(F.array_contains(mods, w) & next_is_cue(i)) & ~F.array_contains(stop, w)))
    # A cue word after a modifier asks for the narrower kind only.
    wide = F.filter("words", lambda w, i: is_cue(w) & ~F.coalesce(F.array_contains(mods, F.get("words", F.greatest(i - 1, F.lit(0)))) & (i > 0), F.lit(False)))
    narrow = F.exists("words", lambda w: F.array_contains(mods, w)) & (F.size(F.filter("words", lambda w, i: F.array_contains(mods, w) & next_is_cue(i))) > 0)
    keys = lambda table: F.array(*map(F.lit, table))
    none = F.array().cast("array<string>")
    types = F.array_union(F.filter(of("type"), lambda v: v.isin(*ITEM_TYPES)), _named(F.col("cue_tokens"), TYPE_CUES, keys(TYPE_CUES)))
    kinds = F.array_union(of("kind"), F.array_union(_named(wide, KIND_CUES, keys(KIND_CUES)), F.when(narrow, F.array(F.lit("macos_app"))).otherwise(none)))
    phrases = F.filter(F.transform("quoted", lambda p: tokenize(p)), lambda p: F.size(p) > 0)
    flat = F.trim(F.regexp_replace("t", r"\s+", " "))
    embed = F.trim(F.concat_ws(" ", F.when(flat != "", flat), F.array_join(F.transform(phrases, lambda p: F.array_join(p, " ")), " ")))
    return df.select(
        "query_id",
        tokens.alias("tokens"),
        phrases.alias("phrases"),
        "cue_tokens",
        types.alias("types"),
        _named(F.col("cue_tokens"), SUBTYPE_CUES, keys(SUBTYPE_CUES)).alias("subtypes"),
        kinds.alias("kinds"),
        F.transform(of("domain"), lambda d: F.regexp_replace(d, r"^www\.", "")).alias("domains"),
        ((F.size(of("type")) > 0) | (F.size(of("kind")) > 0)).alias("strict"),
        F.array_contains(types, "note").alias("note_cue"),
        "since",
        "until",
        F.col("w.label").alias("time_label"),
        F.when(embed != "", embed).otherwise(F.trim(F.coalesce("raw", F.lit("")))).alias("embed_text"),
    )
