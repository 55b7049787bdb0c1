"""Text expressions over Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the results are defined by.
PLACEHOLDER = "[Translation unavailable]"
GARBLED = ("\ufffd", "\u00c3")
REPEAT_VARIANT = ("这一次", "这次")
REPEAT_MARKS = "，。？！,.?!"
HALF_MARKS, FULL_MARKS = ",?!;:", "，？！；："
TITLE_MARKS = r"[，,。！？!?\s]+"
TITLE_DEFAULTS = (("A Shocking Family Twist", "家庭冲突爆发"), ("The Truth Comes Out", "真相终于揭开"))
PLOT_TITLES = (("Wife Sets a Divorce Trap", "妻子设局逼离婚"), ("Mother-in-law Was Behind It", "丈母娘竟是主谋"))
PLOT_ALL, PLOT_ANY = ("离婚", "妈"), ("定位", "GPS")
TRANSIENT = ("timeout", "timed out", "temporarily", "connection", "reset", "rate limit", "429", "500", "502", "503", "504", "remote end closed", "ssl", "eof")
CRASHES = ("3221225477", "access violation", "0xc0000005")
STATUS_LABELS = {"success": "OK", "failed": "FAILED", "running": "RUNNING", "pending": "PENDING", "not_run": "NOT_RUN", "skipped": "SKIPPED", "disabled": "DISABLED"}


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def is_blank(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit(""))) == ""


def has_cjk(text: Column) -> Column:
    return text.rlike("[\u3400-\u9fff]")


def is_garbled(text: Column) -> Column:
    return text.contains(GARBLED[0]) | text.contains(GARBLED[1])


def ass_escape(text: Column) -> Column:
    out = text
    for a, b in (("{", r"\{"), ("}", r"\}"), ("\n", r"\N")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def full_width(text: Column) -> Column:
    """Half-width marks in their full-width form."""
    return F.translate(text, HALF_MARKS, FULL_MARKS)


def repeat_key(text: Column) -> Column:
    """What two cues have to share to count as one repeated text."""
    return F.translate(F.replace(strip(text), *map(F.lit, REPEAT_VARIANT)), REPEAT_MARKS, "")


def wrap(line: Column, limit: int = 42) -> Column:
    """Greedy lines of at most ``limit`` characters; a longer word stands alone; a line without words stays."""
    words = F.filter(F.split(line, r"(?U)\s+"), lambda w: w != "")
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(s: Column, w: Column) -> Column:
        longer = F.when(s["open"] == "", w).otherwise(F.concat(s["open"], F.lit(" "), w))
        fits = F.length(longer) <= limit
        done = F.when(fits | (s["open"] == ""), s["done"]).otherwise(F.array_append(s["done"], s["open"]))
        return F.struct(done.alias("done"), F.when(fits, longer).otherwise(w).alias("open"))

    return F.when(F.size(words) == 0, F.array(line)).otherwise(F.aggregate(words, state, add, lambda s: F.array_append(s["done"], s["open"])))


def lines_of(text: Column) -> Column:
    """Lines of a text; a line feed at its end opens none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\n$", ""), "\n"))


def rebalance(text: Column, limit: int = 42) -> Column:
    """Wrapped lines if there are at most two, else two lines of half of them each."""
    parts = F.flatten(F.transform(lines_of(text), lambda x: wrap(x, limit)))
    half = F.greatest(F.lit(1), F.floor(F.size(parts) / 2).cast("int"))
    two = F.concat_ws("\n", F.array_join(F.slice(parts, F.lit(1), half), " "), F.array_join(F.slice(parts, half + 1, F.size(parts)), " "))
    return F.when(F.size(parts) <= 2, F.array_join(parts, "\n")).otherwise(two)


def chars_per_second(text: Column, start_ms: Column, end_ms: Column) -> Column:
    return F.length(F.replace(text, F.lit("\n"), F.lit(""))) / F.greatest(F.lit(0.001), (end_ms - start_ms) / F.lit(1000.0))


def unfence(text: Column) -> Column:
    """Without the code fence around it."""
    t = strip(text)
    inner = F.regexp_replace(F.regexp_replace(t, r"(?U)^```\w*\s*", ""), r"(?U)\s*```$", "")
    return F.when(t.startswith("```"), strip(inner)).otherwise(t)


def lenient_json(text: Column) -> Column:
    """The text's JSON, or that of its first ``{`` to its last ``}``, as a variant; null if neither parses."""
    t = unfence(text)
    return F.coalesce(F.try_parse_json(t), F.try_parse_json(F.regexp_extract(t, r"(?s)\{.*\}", 0)))


def llm_content(body: Column) -> Column:
    """The first choice's content of a completion; JSON text if it is no string; null where the body holds an error."""
    v = F.try_parse_json(body)
    content = F.try_variant_get(v, "$.choices[0].message.content", "variant")
    text = F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(v, "$.choices[0].message.content", "string")).otherwise(F.to_json(content))
    return F.when(F.try_variant_get(v, "$.error", "variant").isNull(), text)


def compact_zh(text: Column) -> Column:
    return F.substring(F.regexp_replace(text, "(?U)" + TITLE_MARKS, ""), 1, 10)


def compact_en(text: Column) -> Column:
    return rstrip(F.substring(collapse(text), 1, 34))


def _groups(pairs) -> Column:
    return F.array(*(F.struct(F.lit(en).alias("en"), F.lit(zh).alias("zh")) for en, zh in pairs))


def local_titles(stem: Column, zh: Column, every: bool = True) -> Column:
    """Two title groups from a file's stem, or the plot's own where its words occur.

    From a ``#`` on a line goes: ``every`` line of a stem that has several, or only the first one with a ``#``.
    """
    plain = F.regexp_replace(stem, "^[a-zA-Z0-9]+", "")
    untagged = F.regexp_replace(plain, r"#[^\n]*" if every else r"(?s)^([^#]*)#[^\n]*(.*)$", "" if every else "$1$2")
    title = F.regexp_replace(untagged, "(?U)" + TITLE_MARKS, "")
    whole = F.length(title) >= 12
    halves = [F.substring(title, 1, 8), F.substring(title, 9, 8)]
    groups = F.array(*(F.struct(F.lit(en).alias("en"), F.when(whole | (h != ""), h).otherwise(F.lit(zh)).alias("zh")) for (en, zh), h in zip(TITLE_DEFAULTS, halves, strict=True)))
    plot = zh.contains(PLOT_ALL[0]) & zh.contains(PLOT_ALL[1]) & (zh.contains(PLOT_ANY[0]) | zh.contains(PLOT_ANY[1]))
    return F.when(plot, _groups(PLOT_TITLES)).otherwise(groups)


def title_groups(groups: Column) -> Column:
    """The first two groups that have both titles, compacted; fewer than two give the default pair."""
    clean = F.transform(F.slice(groups, 1, 2), lambda g: F.struct(strip(F.coalesce(g["en"], F.lit(""))).alias("en"), strip(F.coalesce(g["zh"], F.lit(""))).alias("zh")))
    both = F.filter(clean, lambda g: (g["en"] != "") & (g["zh"] != ""))
    short = F.transform(both, lambda g: F.struct(compact_en(g["en"]).alias("en"), compact_zh(g["zh"]).alias("zh")))
    return F.when(F.size(short) < 2, _groups(TITLE_DEFAULTS)).otherwise(short)


def has_any(text: Column, tokens) -> Column:
    return F.exists(F.array(*map(F.lit, tokens)), lambda t: F.contains(F.lower(text), t))


def is_transient(message: Column) -> Column:
    return has_any(message, TRANSIENT)


def is_crash(message: Column) -> Column:
    return has_any(message, CRASHES)


def _solid_lines(text: Column) -> Column:
    return F.filter(lines_of(text), lambda x: strip(x) != "")


def only_progress(text: Column, marks=("frames/s", "%|")) -> Column:
    """Every line that is not blank holds one of the marks; false without such lines."""
    ls = _solid_lines(text)
    held = lambda x: F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(x, m))
    return (F.size(ls) > 0) & F.forall(ls, held)


def tail_lines(text: Column, n: int = 80) -> Column:
    ls = _solid_lines(text)
    return F.array_join(F.slice(ls, F.greatest(F.lit(1), F.size(ls) - n + 1), F.greatest(F.lit(1), F.size(ls))), "\n")


def error_summary(text: Column, progress=("frame=", "size="), errors=("error", "failed", "invalid", "unable", "cannot", "denied"), n: int = 20) -> Column:
    """Without lines that start as progress does, those that name an error if any do; the last ``n``."""
    ls = F.filter(_solid_lines(text), lambda x: ~F.exists(F.array(*map(F.lit, progress)), lambda m: F.startswith(F.ltrim(x), m)))
    bad = F.filter(ls, lambda x: F.exists(F.array(*map(F.lit, errors)), lambda m: F.contains(F.lower(x), m)))
    kept = F.when(F.size(bad) > 0, bad).otherwise(ls)
    return F.array_join(F.slice(kept, F.greatest(F.lit(1), F.size(kept) - n + 1), F.greatest(F.lit(1), F.size(kept))), "\n")


def filter_path(text: Column) -> Column:
    out = text
    for a, b in (("\\", "/"), (":", r"\:"), ("'", r"\'")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def data_url(mime: Column, content: Column) -> Column:
    """One line, whatever its length: line ends that the encoder puts in after every 76 characters are taken out."""
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.replace(F.base64(content), F.lit("\r\n"), F.lit("")))


def redact(config: Column, key: str = "api_key") -> Column:
    """A map with a non-empty value of ``key`` hidden."""
    return F.transform_values(config, lambda k, v: F.when((k == key) & (F.coalesce(v, F.lit("")) != ""), F.lit("***REDACTED***")).otherwise(v))


def status_label(status: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in STATUS_LABELS.items() for x in kv))
    return F.coalesce(table[status], F.upper(status))


def backoff(base: Column, factor: Column, attempt: Column) -> Column:
    return F.greatest(F.lit(0.0), base * F.pow(factor, attempt))


def fill_template(template: str, srt: Column, mark: str = "{{srt}}") -> Column:
    return F.replace(F.lit(template), F.lit(mark), srt)


def clamp_int(value: Column, low: Column, high: Column, numeric: bool = False) -> Column:
    """An integer in bounds; what is none gives the lower one. Numbers lose their fraction, texts may have none."""
    n = value.cast("double").cast("long") if numeric else F.when(F.trim(value).rlike(r"^[+-]?\d+$"), F.trim(value).try_cast("long"))
    return F.greatest(low, F.least(high, F.coalesce(n, low)))
