"""Ordered rules over questions: intents with confidences, the agent for each, and the entities that a question names.

A rule is data, and a list of them becomes one expression that Catalyst evaluates inside the scan's stage. Words for
diseases, drugs, symptoms and examinations are the caller's.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``intent`` with ``confidence`` if the text begins with ``start`` and each of ``groups`` has a word that it contains."""

    intent: str
    confidence: float
    groups: tuple[tuple[str, ...], ...] = ()
    start: str = ""


@dataclass(frozen=True)
class Words:
    diseases: tuple[str, ...] = ()
    drugs: tuple[str, ...] = ()
    symptoms: tuple[str, ...] = ()
    examinations: tuple[str, ...] = ()
    #: Diseases of the rules; those of ``diseases`` if empty.
    known: tuple[str, ...] = field(default=())


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(re.escape(w) for w in words)) if words else F.lit(False)


def classified(text: Column, rules: list[Rule]) -> Column:
    """struct(intent, confidence) of the first rule that fits; null where none does, or the text is null."""
    out = F.lit(None).cast("struct<intent: string, confidence: double>")
    for rule in reversed(rules):
        fits = F.startswith(text, F.lit(rule.start)) if rule.start else text.isNotNull()
        for words in rule.groups:
            fits = fits & contains_any(text, words)
        out = F.when(fits, F.struct(F.lit(rule.intent).alias("intent"), F.lit(rule.confidence).alias("confidence"))).otherwise(out)
    return out


def named(text: Column, words: Words, found: Column | None = None) -> Column:
    """The words of all four lists that the text contains, and those in the array ``found``; sorted, each once."""
    every = tuple(dict.fromkeys((*words.diseases, *words.drugs, *words.symptoms, *words.examinations)))
    listed = F.filter(F.array(*map(F.lit, every)).cast("array<string>"), lambda w: F.contains(text, w))
    return F.array_sort(F.array_distinct(F.concat(listed, F.coalesce(found, F.array().cast("array<string>"))) if found is not None else listed))


# --- fixed values: phrases of the rules, in their order, the agents, and the words that tell how to search ------------

DRUG_PHRASES = ("副作用", "用法", "用量", "服用", "药", "药物", "吃什么药", "能吃", "不能吃", "治疗什么", "能治疗", "用于", "能治什么", "禁忌")
ADVICE = ("注意什么", "吃什么", "怎么补", "饮食")
AGENTS = {"symptom_query": "symptom_agent", "disease_query": "disease_agent", "drug_query": "drug_agent", "treatment_query": "treatment_agent"}
OTHER_AGENT = "general_agent"
GLOBAL_WORDS = ["总结", "概述", "整体", "主要", "全部", "共有", "介绍", "简述", "总览", "概况", "全面", "整体来看", "对比", "比较", "区别", "异同", "分类"]
LOCAL_WORDS = ["谁", "什么", "哪个", "详细", "具体", "如何", "有哪些", "是什么", "在哪里", "为什么", "怎么样", "原因", "治疗", "症状", "副作用", "用法", "用量", "检查", "预防", "注意", "建议"]
NUMERIC_WORDS = ["多少", "数量", "统计", "排名", "前", "最高", "最低"]
#: Rules for the template of an expanded question.
FINE_DRUGS = ("药", "素", "苷", "林", "平", "汀", "普利", "沙坦", "洛尔", "阿司匹林", "胰岛素", "二甲双胍")
FINE_RULES = [
    Rule("drug_interaction", 1.0, (FINE_DRUGS, ("相互作用", "联用"))),
    Rule("drug_query", 1.0, (FINE_DRUGS,)),
    Rule("diagnosis_assist", 1.0, (("诊断", "鉴别", "检查", "提示"),)),
    Rule("treatment_query", 1.0, (("治疗", "用药", "手术", "方案"),)),
    Rule("examination_query", 1.0, (("检查", "检验", "指标", "正常值"),)),
    Rule("symptom_query", 1.0, (("症状", "表现", "感觉"),)),
]
#: Hints of a kind, for questions whose intent isn't told: (diseases, symptoms, drugs).
HINTS = (("病", "症", "炎", "癌", "瘤", "肿", "梗死", "出血", "衰竭"), ("痛", "晕", "热", "咳", "吐", "泻", "悸", "闷"), ("药", "素", "苷", "林", "平", "汀", "普利", "沙坦", "洛尔"))


def rules(words: Words) -> list[Rule]:
    """The rules of a question's intent, with the caller's words for drugs, symptoms and diseases."""
    sick, signs = words.known or words.diseases, words.symptoms
    return [
        Rule("drug_query", 0.9, (words.drugs,)),
        Rule("drug_query", 0.85, (DRUG_PHRASES,)),
        Rule("treatment_query", 0.9, (("康复",),)),
        Rule("symptom_query", 0.95, (("怎么办",), signs)),
        Rule("symptom_query", 0.95, (("发作",), ("处理",))),
        Rule("symptom_query", 0.9, (("发作",), signs)),
        Rule("diagnosis_assist", 0.9, (("是怎么回事", "是什么病", "什么问题", "是什么原因"),), "我"),
        Rule("health_advice", 0.85, (ADVICE,), "我"),
        Rule("diagnosis_assist", 0.85, (signs,), "我"),
        Rule("health_advice", 0.85, ((*ADVICE, "补什么"),)),
        Rule("disease_query", 0.9, (("有什么症状", "高危因素", "后遗症", "传播途径", "表现"), sick)),
        Rule("disease_query", 0.9, (("如何延缓", "怎么治疗"), sick)),
        Rule("disease_query", 0.9, (("治疗", "怎么治", "如何治"), sick)),
        Rule("treatment_query", 0.8, (("治疗", "怎么治", "如何治"),)),
        Rule("disease_query", 0.85, (sick, ("是什么", "什么是", "病因", "诊断", "传染", "如何", "多大"))),
        Rule("symptom_query", 0.8, (("原因", "为什么"), signs)),
        Rule("examination_query", 0.85, (("检查", "空腹", "化验", "需要检查"),)),
        Rule("prevention_query", 0.85, (("预防", "如何预防"),)),
        Rule("disease_query", 0.8, (sick,)),
    ]


def agent(intent: Column, agents: dict[str, str] = AGENTS, other: str = OTHER_AGENT) -> Column:
    """The agent of an intent; ``other`` for those without one and for null."""
    pairs = F.create_map(*[F.lit(x) for pair in agents.items() for x in pair])
    return F.coalesce(F.element_at(pairs, intent), F.lit(other))


def hinted(text: Column, hints: tuple[tuple[str, ...], ...] = HINTS) -> Column:
    """Intents to try for a question whose intent isn't told: by hints of diseases with symptoms, else of drugs, else none."""
    sick, signs, drugs = (contains_any(text, h) for h in hints)
    both = lambda *names: F.array(*map(F.lit, names))
    return F.when(sick & signs, both("diagnosis_assist", "symptom_query")).when(drugs, both("drug_query", "drug_interaction")).otherwise(F.array().cast("array<string>"))
