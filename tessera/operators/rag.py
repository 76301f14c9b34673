"""Questions: intent, filters by status, how many passages, context and prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vector import LIST_K, TOP_K

#: Words of a question that ask for issues of a status; the first list that fits wins.
INTENT = {
    "done": ["done", "완료", "closed", "resolved", "finished", "끝난"],
    "progress": ["progress", "진행", "working", "in progress", "진행중"],
    "pending": ["pending", "대기", "todo", "to do", "할일", "open", "backlog"],
}
#: A status's category, words in its name, and its label.
STATUS = {"done": ("Done", ["done", "완료", "closed", "resolved"], "완료"), "progress": ("In Progress", ["progress", "진행"], "진행중"), "pending": ("To Do", ["todo", "open", "backlog", "대기"], "대기")}
#: Words of a question that ask for a list.
LIST_WORDS = ["all", "모든", "전체", "목록", "리스트", "list", "show me", "보여"]
SEPARATOR = "\n\n---\n\n"
#: Fixed value: the instruction that goes before the context.
PROMPT = """당신은 문서 기반 질문 답변 도우미입니다.
아래 문서 내용을 바탕으로 질문에 답변하세요.
문서에 없는 내용은 "문서에서 해당 정보를 찾을 수 없습니다"라고 답하세요.

문서 내용:
"""


def any_of(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def intent(prompt: Column) -> Column:
    low = F.lower(prompt)
    out = F.lit(None).cast("string")
    for name, words in reversed(INTENT.items()):
        out = F.when(any_of(low, words), name).otherwise(out)
    return out


def wants_list(prompt: Column) -> Column:
    return any_of(F.lower(prompt), LIST_WORDS)


def passages(prompt: Column, available: Column | int) -> Column:
    return F.when(wants_list(prompt), F.least(F.lit(LIST_K), available if isinstance(available, Column) else F.lit(available))).otherwise(F.lit(TOP_K))


def status_group(name: Column, category: Column, group: str) -> Column:
    is_category, words, _ = STATUS[group]
    return F.coalesce(category == is_category, F.lit(False)) | any_of(F.lower(F.coalesce(name, F.lit(""))), words)


def filter_issues(issues: DataFrame, group: str) -> DataFrame:
    """issues (status, status_category, ...) of the group a question asks for."""
    return issues.where(status_group(F.col("status"), F.col("status_category"), group))


def status_context(issues: DataFrame, group: str, order: str = "key", *by: str) -> DataFrame:
    """`status_context` for each value of `by` (one row without any): a header with the count and a line for each issue (key, summary, status), in order.

    Meant for the issues of one session at a time, which the header lists in full."""
    found = filter_issues(issues, group)
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.concat(F.lit("- "), "key", F.lit(": "), "summary", F.lit(" (상태: "), "status", F.lit(")\n")).alias("line"))))
    head = F.concat(F.lit(f"\n\n[{STATUS[group][2]} 상태 이슈 "), F.count(F.lit(1)).cast("string"), F.lit("개]\n"))
    return found.groupBy(*by).agg(F.when(F.count(F.lit(1)) > 0, F.concat(head, F.array_join(F.transform(lines, lambda x: x["line"]), ""))).alias("status_context"))


def context_part(source: Column, text: Column) -> Column:
    return F.concat(F.lit("[출처: "), F.coalesce(source, F.lit("unknown")), F.lit("]\n"), text)


def assemble_context(hits: DataFrame, by: str = "query_id", order: str = "rank", source: str = "source", text: str = "text", status: str | None = None) -> DataFrame:
    """(by, context): the parts of each question's hits in order; a status block, where there is one, goes first."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), context_part(F.col(source), F.col(text)).alias("p")))), lambda x: x["p"])
    if status is not None:
        parts = F.concat(F.filter(F.array(F.first(status, ignorenulls=True)), lambda s: s.isNotNull()), parts)
    return hits.groupBy(by).agg(F.array_join(parts, SEPARATOR).alias("context"))


def build_prompt(context: Column) -> Column:
    return F.concat(F.lit(PROMPT), context)
