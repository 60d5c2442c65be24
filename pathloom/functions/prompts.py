"""Prompt rendering and the split of generated tokens, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TASK = "Below is an instruction that describes a task. Write a response that appropriately completes the request.\n\n"
#: Parts of the published prompt templates (fixed values).
TEMPLATES = {
    "qa": {"system": "", "before_query": "User:\n", "after_query": "\n\n", "before_answer": "Assistant:\n", "hint": "", "between": "\n\n"},
    "alpaca": {"system": _TASK, "before_query": "### Instruction:\n", "after_query": "\n\n", "before_answer": "### Response:\n", "hint": "", "between": "\n\n"},
    "wizardmath-cot": {"system": _TASK, "before_query": "### Instruction:\n", "after_query": "\n\n", "before_answer": "### Response: ", "hint": "Let's think step by step.", "between": "\n\n"},
    "deepseekmath": {
        "system": "", "before_query": "User: ", "after_query": "\nPlease reason step by step, and put your final answer within \\boxed{}.\n\n",
        "before_answer": "Assistant: ", "hint": "", "between": "<｜end▁of▁sentence｜>",
    },
    "deepseekmath-tool": {
        "system": "", "before_query": "User: ", "after_query": "\nPlease integrate natural language reasoning with programs to solve the problem above, and put your final answer within \\boxed{}.\n\n",
        "before_answer": "Assistant: ", "hint": "", "between": "<｜end▁of▁sentence｜>",
    },
    "xwinmath": {
        "system": "A chat between a curious user and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the user's questions. ",
        "before_query": "USER: ", "after_query": " Give your solution in detail. In the end, write your final answer in the format of 'The answer is: <ANSWER>.'.  ",
        "before_answer": "ASSISTANT: ", "hint": "", "between": "\n\n",
    },
    "mammoth2-cot": {"system": "You are supposed to provide a solution to a given problem.\n\n\n", "before_query": "Problem:\n", "after_query": "\n", "before_answer": "Solution: ", "hint": "Let's think step by step.\n", "between": "\n\n"},
    "llama3-math": {
        "system": "<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\nYou are a helpful agent on solving math problems.<|eot_id|>",
        "before_query": "<|start_header_id|>user<|end_header_id|>\n\n", "after_query": "<|eot_id|>", "before_answer": "<|start_header_id|>assistant<|end_header_id|>\n\n", "hint": "", "between": "<|eot_id|>\n",
    },
}
#: The published turns of the chat models: what opens and closes a turn, the system text, and an empty thinking part (fixed values).
CHAT_OPEN, CHAT_CLOSE, CHAT_SYSTEM, NO_THINKING = "<|im_start|>", "<|im_end|>\n", "You are a helpful assistant.", "<think>\n\n</think>\n\n"
#: Model families by parts of the lower-case name, one of each group, in this order: (family, groups, has a system turn, thinks) (fixed values).
FAMILIES = (
    ("qwen3", (("qwen3",),), False, True), ("qwen1.5-moe", (("qwen1.5", "qwen1_5"), ("moe",), ("chat",)), True, False), ("qwen2.5", (("qwen2.5", "qwen2_5"), ("instruct",)), True, False),
)
#: Id of the token that ends a thinking part (fixed value).
THINK_END = 151668


def render(query: Column, template: dict[str, str], examples: list[tuple[str, str]] = (), hint: str | None = None) -> Column:
    """The full prompt: system text, worked examples, the query; blanks at the very end are cut. ``hint`` replaces the template's own start of an answer."""
    start = template["hint"] if hint is None else hint
    one = lambda q: F.concat(F.lit(template["before_query"]), q, F.lit(template["after_query"] + template["before_answer"] + start))
    shots = [F.concat(one(F.lit(q)), F.lit(a)) for q, a in examples]
    return F.concat(F.lit(template["system"]), F.concat_ws(template["between"], *shots, F.rtrim(one(query))))


def thinking_split(tokens: Column, thinking_enabled: Column, limit: int, end_ids: list[int]) -> Column:
    """struct(thinking_tokens, answer_tokens, status, ended, hit_limit) of generated token ids.

    status: complete with an end mark, missing_end_marker if thinking was on without one, else disabled.
    """
    back = F.array_position(F.reverse(tokens), F.lit(THINK_END))
    n = F.size(tokens)
    marked = F.coalesce(back > 0, F.lit(False))
    ended = F.coalesce(F.try_element_at(tokens, F.lit(-1)).isin(*end_ids), F.lit(False))
    return F.struct(
        F.when(marked, n - back).when(thinking_enabled, n).otherwise(0).cast("int").alias("thinking_tokens"),
        F.when(marked, back - 1).when(thinking_enabled, 0).otherwise(n).cast("int").alias("answer_tokens"),
        F.when(marked, "complete").when(thinking_enabled, "missing_end_marker").otherwise("disabled").alias("status"),
        ended.alias("ended"), ((n >= limit) & ~ended).alias("hit_limit"),
    )


def markdown_cell(text: Column) -> Column:
    """Text for a table cell: bars escaped, line breaks as blanks."""
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def _named(name: Column, groups: tuple[tuple[str, ...], ...]) -> Column:
    """``name`` has one part of each group."""
    n, out = F.lower(name), F.lit(True)
    for group in groups:
        some = F.lit(False)
        for part in group:
            some = some | n.contains(part)
        out = out & some
    return out


def model_family(name: Column) -> Column:
    """The chat family of a model by its name; null for models without chat turns."""
    return F.coalesce(*(F.when(_named(name, groups), family) for family, groups, *_ in FAMILIES))


def chat(name: Column, text: Column) -> Column:
    """``text`` as the user's turn for the chat family of a model, ready for its answer; other models get the text as it is."""
    turn = lambda role, x: F.concat(F.lit(CHAT_OPEN + role + "\n"), x, F.lit(CHAT_CLOSE))
    out = text
    for _, groups, system, thinks in reversed(FAMILIES):
        parts = [turn("system", F.lit(CHAT_SYSTEM))] * system + [turn("user", text), F.lit(CHAT_OPEN + "assistant\n" + NO_THINKING * thinks)]
        out = F.when(_named(name, groups), F.concat(*parts)).otherwise(out)
    return out


#: Layers of the supported models by parts of the name (fixed values).
DEPTHS = (((("qwen1.5", "qwen1_5"), ("moe",)), 24), ((("qwen2.5", "qwen2_5"), ("3b",)), 36), ((("qwen3",), ("8b",)), 36), ((("llama-3.2",), ("3b",)), 28))


def model_depth(name: Column) -> Column:
    """Layers of a supported model by its name; null for others."""
    return F.coalesce(*(F.when(_named(name, groups), depth) for groups, depth in DEPTHS))


#: Answer kinds of the contest prompts, in the order in which they are looked for (fixed values).
ANSWER_KINDS = (("Numerical", "a numerical value"), ("Expression", "an expression"), ("Equation", "an equation"), ("Interval", "an interval"))


def answer_kind(kind: Column) -> Column:
    """The phrase for one answer kind; null for unknown ones."""
    out = F.lit(None).cast("string")
    for name, phrase in reversed(ANSWER_KINDS):
        out = F.when(F.substring_index(kind, "-", 1).contains(name), phrase).otherwise(out)
    return out


def contest_prompt(kind: Column, multiple: Column, unit: Column, subject: str = "Math") -> Column:
    """The instruction of an open-ended contest problem: what kind of answer, how many, with or without unit.

    The wording of all sentences is fixed by the published prompt (fixed values).
    """
    kinds = F.transform(F.split(kind, ","), answer_kind)
    several = F.when(F.size(F.array_distinct(kinds)) == 1, F.concat(F.lit("The problem has multiple answers, each of them should be "), kinds[0], F.lit(". "))).otherwise(
        F.concat(F.lit("The problem has multiple answers, with the answers in order being "), F.array_join(kinds, ", "), F.lit(". "))
    )
    said = F.when(kind.contains("Need_human_evaluate") | kind.contains("Tuple"), "").when(multiple, several).otherwise(F.concat(F.lit("The answer of The problem should be "), answer_kind(kind), F.lit(". ")))
    with_unit = F.coalesce(unit != "", F.lit(False))
    box = F.concat(F.when(multiple, "\\boxed{multiple answers connected with commas}").otherwise("\\boxed{answer}"), F.when(with_unit, "(unit)").otherwise(""))
    note = F.when(with_unit, ", note that the unit of the answer should not be included in \\boxed{}").otherwise("")
    return F.concat(
        F.lit(f"The following is an open-ended problem from an International {subject} competition. "), said,
        F.lit("Please calculate the answer according to the given requirements and the information provided. Please use LaTeX format to represent the variables and formulas used in the solution process and results. "),
        F.lit('Please end your solution with "So the final answer is '), box, F.lit('." and give the result explicitly'), note, F.lit("."),
    )
