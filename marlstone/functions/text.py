"""Text expressions: white space, tokens, terms, cues of evidence.

Texts may be Latin or Chinese: runs of Chinese characters give their two- and
three-character pieces as tokens. All are built-in column expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space, token patterns, stop words, cue patterns.
SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TOPIC_WORD = r"[A-Za-z][A-Za-z0-9_-]{2,}|[\x{4e00}-\x{9fff}]{2,8}"
SEARCH_WORD = r"[a-z][a-z0-9_.-]+|[\x{4e00}-\x{9fff}]{2,}"
CLAIM_WORD = r"[a-z][a-z0-9_.-]+|[\x{4e00}-\x{9fff}]{2,8}"
CHINESE = r"^[\x{4e00}-\x{9fff}]+$"
TOPIC_STOPWORDS = ["the", "and", "for", "with", "from", "this", "that", "研究", "分析", "报告", "文档", "文件", "资料", "进行", "一种", "基于", "相关", "情况", "数据", "方法"]
TERM_STOPWORDS = ["内容", "文件", "文档", "资料", "分析", "主要", "相关", "情况", "主题", "研究"]
QUESTION_STOPWORDS = ["问题", "哪些", "什么", "为何", "为什么", "如何", "是否", "怎么", "怎样", "请问", "请分析", "一下", "可以", "能够", "需要", "有关", "这个", "该"]
NEGATION = "未|无|没有|不能|无法|不可|并非|尚未|避免|缺乏|不(是|能|可|会|应|得|具有|存在|支持|符合|包含|包括|采用|提供|实现|导致)"
ABSOLUTE = "完全|绝对|全部|必然|彻底|始终|永久|百分之百|100%"
FACT = "是|为|具有|通过|采用|支持|提供|实现|包括|导致|提升|降低|减少|增加|能够|可以|用于|依赖|需[要须]|应当|必须|表明|显示|发现|证明|说明|源于|结果|优势|特点|机制|原因|影响|风险|限制|缺陷|许可|安全|成本|性能"
QUANTITY = r"[0-9]+(\.[0-9]+)?\s*(%|％|万|亿|吨|元|天|次|例|倍|项|种)"
CLAIM_NUMBER = r"[0-9]+(?:\.[0-9]+)?\s*(?:%|％|万|亿|吨|元|天|次|例|倍|项|种)?"
INDIRECT = {
    "经济影响": ["吞吐", "收入", "产量", "就业", "价格", "增长", "下降", "成本"],
    "冲突": ["伤亡", "袭击", "攻击", "停火", "战斗", "流离失所"],
    "风险": ["损失", "故障", "异常", "事故", "暴露", "攻击"],
    "效果": ["提升", "下降", "准确率", "召回率", "对照", "实验结果"],
}
SENTENCE_END = "[。！？；.!?;]"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once for a row, however often ``then`` uses it, in lambdas too."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def words(items: list[str]) -> Column:
    return F.array(*map(F.lit, items))


def collapse(c: Column) -> Column:
    """White space runs as one blank, none at the ends; null stays null."""
    return F.btrim(F.regexp_replace(c, f"{SPACE}+", " "))


def short(c: Column, limit: int) -> Column:
    return F.substring(collapse(c), 1, limit)


def all_matches(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0))


def pieces(c: Column, n: int) -> Column:
    """All runs of n characters."""
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def _with_pieces(found: Column) -> Column:
    return F.flatten(F.transform(found, lambda w: F.when(w.rlike(CHINESE), F.concat(F.array(w), pieces(w, 2), pieces(w, 3))).otherwise(F.array(w))))


def topic_words(c: Column) -> Column:
    """Words of three characters or more, and Chinese runs, without stop words; in order, repeats included."""
    lower = F.transform(all_matches(c, TOPIC_WORD), lambda w: F.lower(w))
    return F.filter(lower, lambda w: ~w.isin(TOPIC_STOPWORDS))


def search_words(c: Column) -> Column:
    """Tokens for ranked search, repeats included. A Chinese run counts as itself and as its pieces."""
    return _with_pieces(all_matches(F.lower(c), SEARCH_WORD))


def claim_terms(c: Column) -> Column:
    """Distinct terms that can tie a statement to a source."""
    found = F.filter(all_matches(F.lower(c), CLAIM_WORD), lambda w: ~w.isin(TERM_STOPWORDS))
    return F.array_distinct(F.filter(_with_pieces(found), lambda w: ~w.isin(TERM_STOPWORDS + QUESTION_STOPWORDS)))


def strong_terms(terms: Column) -> Column:
    """Terms that are enough by themselves."""
    return F.filter(terms, lambda w: (F.length(w) >= 3) | w.rlike("^[a-z0-9_.-]+$"))


def claim_numbers(c: Column) -> Column:
    return F.array_distinct(all_matches(c, CLAIM_NUMBER))


def chinese_trigrams(c: Column) -> Column:
    run = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\x{4e00}-\x{9fff}]", "")
    return pieces(run, 3)


def factual(c: Column) -> Column:
    """Whether a text states something. All cues are Chinese, so other characters are passed over at once."""
    return c.rlike(rf"(?=[\x{{4e00}}-\x{{9fff}}])(?:{FACT})")


def features(c: Column) -> Column:
    """What a text's fingerprint is made of: topic words and Chinese trigrams."""
    return F.concat(topic_words(c), chinese_trigrams(c))


def human_size(c: Column) -> Column:
    """Bytes as text, 1024 to a step; halves go to the even digit."""
    shown = lambda k, unit: F.format_string(f"%.1f {unit}", F.bround(c.cast("double") / float(1 << k), 1))
    out = shown(40, "TB")
    for k, unit in ((30, "GB"), (20, "MB"), (10, "KB"), (0, "B")):
        out = F.when(c < (1 << (k + 10)), shown(k, unit)).otherwise(out)
    return out


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16))


def path_id(path: Column) -> Column:
    return F.substring(F.sha1(path), 1, 16)


def long_parts(text: Column, most: int = 12, preferred: int = 32_000) -> Column:
    """Array of (index, start, end): parts of at least ``preferred`` characters, about ``most`` of them.

    A part that isn't the last is cut back to the last newline of its last
    quarter. Null and empty texts have none. Pass a column, not an expression.
    """
    n = F.length(text)
    size = F.greatest(F.lit(preferred), F.ceil(n / float(max(1, most))).cast("int"))
    empty = F.array().cast("array<struct<index:int,start:int,end:int>>")

    def step(done: Column, i: Column) -> Column:
        start = F.coalesce(F.get(done, F.size(done) - 1)["end"], F.lit(0))
        end = F.least(n, start + size)
        low = start + F.floor(size * 0.75).cast("int")
        back = F.locate("\n", F.reverse(F.substring(text, low + 1, end - low)))
        cut = F.when((end < n) & (back > 0) & (end - back > start), end - back).otherwise(end)
        return F.when(start >= n, done).otherwise(F.concat(done, F.array(F.struct(i.alias("index"), start.alias("start"), cut.alias("end")))))

    steps = F.sequence(F.lit(1), F.ceil(n / F.floor(size * 0.75)).cast("int") + 1)
    return F.when(F.coalesce(n, F.lit(0)) == 0, empty).otherwise(F.aggregate(steps, empty, step))


def semantic_profile(title: Column, headings: Column, body: Column, most: int = 1700) -> Column:
    """What stands for a document when it is embedded: title, six headings, and its body, of a long one the head, middle and tail.

    body: collapsed. The whole text stays where it is; this is a view for models with a bound.
    """
    first = F.filter(F.transform(F.slice(headings, 1, 8), collapse), lambda h: h != "")
    long = F.concat_ws("\n", F.concat(F.lit("开头："), F.substring(body, 1, 520)), F.concat(F.lit("中段："), F.substring(body, F.greatest(F.lit(0), F.floor(F.length(body) / 2).cast("int") - 220) + 1, F.lit(440))), F.concat(F.lit("结尾："), F.right(body, F.lit(520))))
    parts = [
        F.concat(F.lit("标题："), F.coalesce(F.get(first, F.lit(0)), title, F.lit(""))),
        F.when(F.size(first) > 0, F.concat(F.lit("章节："), F.array_join(F.slice(first, 1, 6), " | "))),
        F.when(F.length(body) > 1200, long).when(F.length(body) > 0, F.concat(F.lit("正文："), body)),
    ]
    return F.substring(F.concat_ws("\n", *parts), 1, most)
