"""Routing of questions by ordered rules, with a model for what the rules leave open."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.text import BLANK, trimmed

SIMPLE, AGENTIC = "SIMPLE_RAG", "AGENTIC_RAG"
#: Signal names and patterns, in the order in which they are tried.
COMPLEX_SIGNALS = [
    ("并列多主题", "[和与跟].{0,20}(都|分别|各自)|分别|各自"),
    ("对比择优", "对比|区别|差异|相比|哪个更|哪个好|哪个比较|哪种更|哪种好|有什么不同"),
    ("要文档原文", "原文|全文|文档|文件|附件|完整内容|列出所有|哪些文件"),
    ("多步推理", "先.{0,15}再|然后|接着|一步步"),
    ("要汇总整理", "总结|汇总|梳理|整理一下|归纳"),
]
SIMPLE_SIGNALS = [("挂号业务", "挂号|预约|号源|退号"), ("寒暄", "(?i)^(你好|您好|hi|hello|嗨)|谢谢|多谢|再见|拜拜|你是谁|你叫什么")]


def rules(questions: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Adds route and reason; both null where no rule decides and a model may be asked."""
    struct = lambda route, reason: F.struct(F.lit(route).alias("route"), F.lit(reason).alias("reason"))
    if not cfg.router_enabled:
        return questions.withColumns({"route": F.lit(SIMPLE), "reason": F.lit("路由已关闭")})
    q = trimmed(F.col("text"))
    d = F.when(F.col("text").isNull() | F.col("text").rlike(BLANK), struct(SIMPLE, "空问题"))
    d = d.when(F.regexp_count(q, F.lit("[?？]")) >= 2, struct(AGENTIC, "规则·多问句"))
    d = d.when(F.length(q) > cfg.complex_min_chars, struct(AGENTIC, f"规则·超长问题(>{cfg.complex_min_chars}字)"))
    for name, pattern in COMPLEX_SIGNALS:
        d = d.when(q.rlike(pattern), struct(AGENTIC, f"规则·{name}"))
    for name, pattern in SIMPLE_SIGNALS:
        d = d.when(q.rlike(pattern), struct(SIMPLE, f"规则·{name}"))
    d = d.when(F.length(q) <= cfg.simple_max_chars, struct(SIMPLE, f"规则·短句(<={cfg.simple_max_chars}字)"))
    if not cfg.llm_fallback:
        d = d.otherwise(struct(SIMPLE, "规则未命中且LLM兜底已关闭"))
    return questions.withColumn("_d", d).select(*questions.columns, "_d.route", "_d.reason")


def decide(questions: DataFrame, classifier=None, cfg: Config = DEFAULT) -> DataFrame:
    """Rules, then ``classifier`` (DataFrame -> DataFrame with answer and failed) on the rows left open, and only on these."""
    ruled = rules(questions, cfg)
    if not cfg.router_enabled or not cfg.llm_fallback:
        return ruled
    left = ruled.where("route IS NULL").drop("route", "reason")
    asked = classifier(left) if classifier else left.withColumns({"answer": F.lit(None).cast("string"), "failed": F.lit(False)})
    complex_ = F.upper("answer").contains("COMPLEX")
    route = F.when(~F.col("failed") & F.col("answer").isNotNull() & complex_, AGENTIC).otherwise(SIMPLE)
    reason = F.when(F.col("failed"), "LLM分类失败降级").when(F.col("answer").isNull(), "LLM·空响应降级").otherwise(F.concat(F.lit("LLM·"), trimmed(F.col("answer"))))
    return ruled.where("route IS NOT NULL").unionByName(asked.withColumns({"route": route, "reason": reason}).drop("answer", "failed"))


def accuracy(decided: DataFrame) -> DataFrame:
    """One row: cases, accuracy, rule_hit_rate (reason starts with 规则)."""
    return decided.agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg((F.col("route") == F.col("expected")).cast("double")), 6).alias("accuracy"), F.round(F.avg(F.col("reason").startswith("规则").cast("double")), 6).alias("rule_hit_rate"))
