"""Text functions: splitting, cleaning, masking and parsing of short replies. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that are trimmed.
_LOW = "".join(map(chr, range(33)))
_SENTENCE_END = "。！？；.!?;\\n"

# Names of secrets, and words that tell the kind of a question.
SECRET_NAMES = ("password", "token", "authorization", "auth-key", "apikey", "apisecret", "jwt", "cookie", "set-cookie", "dbpassword", "secret", "private_key", "access_key", "secret_key", "credentials")
CONCEPT_WORDS = ("什么是", "是什么", "定义", "概念", "概述", "概览", "简介", "介绍", "原理", "架构", "整体", "全局", "基本", "基础")
DETAIL_WORDS = ("如何", "怎么", "怎样", "步骤", "方法", "命令", "参数", "配置", "具体", "详细", "几个", "多少", "哪个", "哪些", "为什么", "原因", "区别", "差异")
OPERATION_WORDS = ("操作", "执行", "运行", "启动", "停止", "重启", "部署", "安装", "卸载", "升级", "回滚", "备份", "恢复")
TROUBLE_WORDS = ("错误", "异常", "失败", "报错", "问题", "故障", "排查", "解决", "修复", "不工作", "无法", "不能")


def pieces(pdf, column: str, most: int = 1 << 20):
    """Runs of rows of a pandas table with about `most` letters or bytes in column, so that a task works out and gives away little at once; none of no rows."""
    start, size = 0, 0
    for i, t in enumerate(pdf[column]):
        own = len(t) if isinstance(t, (str, bytes, bytearray)) else 0
        if size and size + own > most:
            yield pdf.iloc[start:i]
            start, size = i, 0
        size += own
    if start < len(pdf):
        yield pdf.iloc[start:]


def let(value: Column, f) -> Column:
    """f of a value that is worked out once: the only element of an array that a lambda names."""
    return F.element_at(F.transform(F.array(value), f), 1)


def trimmed(text: Column) -> Column:
    """Without characters up to U+0020 at both ends; Spark's own trim takes spaces only."""
    return F.btrim(text, F.lit(_LOW))


def blank(text: Column) -> Column:
    return text.isNull() | (trimmed(text) == "")


def sentences(text: Column) -> Column:
    """Pieces up to and with a sentence end, trimmed, without empty ones; a tail without end is kept."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"[^{_SENTENCE_END}]*[{_SENTENCE_END}]|[^{_SENTENCE_END}]+\z"), F.lit(0))
    return F.filter(F.transform(pieces, trimmed), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    """Pieces between blank lines, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\n+"), trimmed), lambda p: p != "")


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def digest(value: Column) -> Column:
    """SHA-256 in hex of a text's UTF-8 or of bytes; null counts as empty."""
    return F.sha2(F.coalesce(value.cast("binary"), F.lit(b"")), 256)


def extension(name: Column) -> Column:
    """What follows the last dot, in lower case; empty without a dot."""
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"(?s)\.([^.]*)\z", 1))


def _clean_end(text: Column) -> Column:
    """Runs of line breaks cut to two, blanks at the end removed, trimmed. What a cheap test rules out is not looked for."""
    text = F.when(F.contains(text, F.lit("\n\n\n")), F.regexp_replace(text, r"\n{3,}", "\n\n")).otherwise(text)
    # trimming takes blanks at the end too, but for those before a line separator that is not trimmed
    odd = F.right(text, F.lit(1)).isin("\x85", "\u2028", "\u2029")
    return trimmed(F.when(odd, F.regexp_replace(text, r"[ \t]+$", "")).otherwise(text))


def clean_txt(text: Column) -> Column:
    return _clean_end(F.replace(text, F.lit("\r\n"), F.lit("\n")))


def clean_pdf(text: Column) -> Column:
    return clean_txt(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))


def clean_html(text: Column) -> Column:
    return trimmed(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))


# Markdown marks and what is left of them, in the order in which they are removed.
MARKS = (
    (r"!\[([^\]]*)\]\([^\)]+\)", "$1"),
    (r"\[([^\]]+)\]\([^\)]+\)", "$1"),
    (r"\*\*([^\*]+)\*\*|__([^_]+)__", "$1$2"),
    (r"\*([^\*]+)\*|_([^_]+)_", "$1$2"),
    (r"`([^`]+)`", "$1"),
)
FIRST_MARKS = ((r"^[-*_]{3,}\s*$", ""), (r"^>\s*", ""))


def clean_markdown(text: Column) -> Column:
    """Plain text of Markdown: image and link texts, without emphasis and code marks; rule and quote at the text's start only."""
    plain = text
    for pattern, keep in MARKS:
        plain = F.regexp_replace(plain, pattern, keep)
    # a text without any of the marks' characters has nothing to remove
    plain = F.when(text.rlike(r"[\[*_`]"), plain).otherwise(text)
    for pattern, keep in FIRST_MARKS:
        plain = F.regexp_replace(plain, pattern, keep)
    return _clean_end(plain)


# Patterns of what is masked.
KEY = r"sk-[A-Za-z0-9]{8,}"
MOBILE = r"(?<!\d)(1[3-9]\d)\d{6}(\d{2})(?!\d)"


def mask_secrets(text: Column) -> Column:
    """Values of secret names as ****: quoted JSON fields first, then name: value and name=value."""
    names = "|".join(n.replace("-", r"\-") for n in SECRET_NAMES)
    quoted = F.regexp_replace(text, rf'(?i)"({names})"\s*:\s*"([^"]+)"', '"$1":"****"')
    masked = F.regexp_replace(quoted, rf"(?i)({names})\s*[:=]\s*(\S+)", "$1=****")
    # without a colon or an equals sign there is no value
    return F.when(text.rlike("[:=]"), masked).otherwise(text)


def mask_keys(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("sk-")), F.regexp_replace(text, KEY, "sk-****")).otherwise(text)


def mask_mobile(text: Column) -> Column:
    return F.regexp_replace(text, MOBILE, "$1****$2")


def mask_message(text: Column) -> Column:
    """Keys, then mobile numbers, as a log line shows them."""
    return mask_mobile(mask_keys(text))


def json_array(reply: Column) -> Column:
    """From the first [ to the last ] of a model's reply, empty if there is none."""
    return F.regexp_extract(reply, r"(?s)\[.*\]", 0)


def unfenced(reply: Column) -> Column:
    """A reply without a code fence around it."""
    inner = F.regexp_extract(trimmed(reply), r"(?s)\A```[A-Za-z]*\s*(.*?)\s*```\z", 1)
    return F.when(inner != "", inner).otherwise(trimmed(reply))


def question_kind(text: Column) -> Column:
    """CONCEPT, DETAIL or GENERAL; a concept word decides first."""
    has = lambda words: text.rlike("(?i)" + "|".join(words))
    return F.when(blank(text), "GENERAL").when(has(CONCEPT_WORDS), "CONCEPT").when(has(DETAIL_WORDS) | has(OPERATION_WORDS) | has(TROUBLE_WORDS), "DETAIL").otherwise("GENERAL")


def granularity(kind: Column) -> Column:
    return F.when(kind == "CONCEPT", "section").when(kind == "DETAIL", "sentence").otherwise("paragraph")


def range_minutes(text: Column) -> Column:
    """Minutes of 7d, 6h, 30m or a bare number; 60 for anything else."""
    low = F.lower(F.coalesce(text, F.lit("")))
    number = F.try_cast(F.regexp_extract(low, r"\A([+-]?\d+)[dhm]?\z", 1), "int") if hasattr(F, "try_cast") else F.regexp_extract(low, r"\A([+-]?\d+)[dhm]?\z", 1).try_cast("int")
    unit = F.when(low.endswith("d"), 1440).when(low.endswith("h"), 60).otherwise(1)
    return F.coalesce(number * unit, F.lit(60))


def iso_of_nanos(text: Column) -> Column:
    """Nanoseconds since 1970 as an ISO instant with milliseconds where there are any; other text as it is."""
    millis = F.floor(text.try_cast("bigint") / F.lit(1_000_000))
    at = F.timestamp_millis(millis)
    shown = F.when(millis % 1000 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    return F.coalesce(shown, text)


def bounded_utf16(text: Column, units: int = 1024) -> Column:
    """At most so many UTF-16 units, never half a pair; null as empty. Spark cuts by code points, so no pair is split."""
    text = F.coalesce(text, F.lit(""))
    wide = lambda t: F.length(F.encode(t, "UTF-16BE")) / 2
    over = F.filter(F.split(F.substring(text, 1, units), ""), lambda c: c != "")
    sized = F.transform(over, lambda c: wide(c).cast("int"))
    fits = F.aggregate(sized, F.struct(F.lit(0).alias("n"), F.lit(0).alias("k")), lambda a, x: F.when(a["n"] + x <= units, F.struct((a["n"] + x).alias("n"), (a["k"] + 1).alias("k"))).otherwise(F.struct((a["n"] + units + 1).alias("n"), a["k"].alias("k"))), lambda a: a["k"])
    return F.when(wide(text) <= units, text).otherwise(F.substring(text, F.lit(1), fits))


def now_in(zone: str) -> Column:
    """The current time in a zone, as yyyy-MM-dd HH:mm:ss."""
    return F.date_format(F.from_utc_timestamp(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), zone), "yyyy-MM-dd HH:mm:ss")


def short_uuid(value: Column) -> Column:
    """The first 16 characters of an identifier without dashes."""
    return F.left(F.replace(value, F.lit("-"), F.lit("")), F.lit(16))
