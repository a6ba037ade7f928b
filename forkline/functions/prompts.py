"""Prompts, chat texts and the fields read back from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from forkline.functions.text import strip, text_or_empty
from forkline.schemas import END_OF_TURN


@dataclass(frozen=True)
class ChatMarks:
    """The fixed texts of a chat format; the defaults are one common format."""

    begin: str = "<|begin_of_text|>"
    header: str = "<|start_header_id|>{role}<|end_header_id|>"
    gap: str = "\n\n"
    end: str = END_OF_TURN

    def head(self, role: str) -> str:
        return self.header.format(role=role)

    def turn(self, role: str, text: Column) -> Column:
        return F.concat(F.lit(self.head(role) + self.gap), text, F.lit(self.end))


MARKS = ChatMarks()

# Section markers inside instructions and prompts.
SCHEMA_MARK = "###Input:\nSchema:\n"
RESPONSE_MARK = "###Response:"
PROMPT_TAIL = "\n###Response:<|eot_id|><|start_header_id|>assistant<|end_header_id|>"
REASONING_END = "</think>"


def _after_first(text: Column, mark: str) -> Column:
    """What follows the first ``mark``, null when it is absent."""
    at = F.instr(text, mark)
    return F.when(at > 0, text.substr(at + len(mark), F.length(text)))


def _before_first(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, 1)


def _after_last(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, -1)


def strip_reasoning(text: Column) -> Column:
    """Keep what follows the first reasoning end mark, stripped."""
    return F.coalesce(strip(_after_first(text, REASONING_END)), text)


def system_user_prompt(instruction: Column, user_input: Column, marks: ChatMarks = MARKS) -> Column:
    """Optional system turn, user turn, then the header of the answer."""
    return F.concat(
        F.lit(marks.begin),
        F.when(text_or_empty(instruction) != "", marks.turn("system", instruction)).otherwise(""),
        marks.turn("user", text_or_empty(user_input)),
        F.lit(marks.head("assistant") + marks.gap),
    )


def user_prompt(question: Column, marks: ChatMarks = MARKS) -> Column:
    return F.concat(
        F.lit(marks.begin), marks.turn("user", question), F.lit(marks.head("assistant") + marks.gap)
    )


def chat_text(question: Column, answer: Column, marks: ChatMarks = MARKS) -> Column:
    return F.concat(F.lit(marks.begin), marks.turn("user", question), marks.turn("assistant", answer))


def question_lenient(prompt: Column, marks: ChatMarks = MARKS) -> Column:
    """The user turn up to its end mark or the end of the text; no header, whole prompt."""
    rest = _after_first(prompt, marks.head("user"))
    return F.coalesce(strip(_before_first(rest, marks.end)), prompt)


def question_strict(prompt: Column, marks: ChatMarks = MARKS) -> Column:
    """The user turn, when header, blank line and end mark are all there; else the prompt."""
    rest = _after_first(prompt, marks.head("user") + marks.gap)
    inner = F.when(F.contains(rest, F.lit(marks.end)), strip(_before_first(rest, marks.end)))
    return F.coalesce(inner, prompt)


def _blocks(text: Column) -> Column:
    return F.split(text, "\n\n")


def prompt_fields(prompt: Column) -> Column:
    """(schema, nl) of a prompt with at least three blocks, else two empty texts."""
    parts = _blocks(prompt)
    enough = F.size(parts) >= 3
    schema = F.when(enough, _after_last(F.get(parts, 1), "\n" + SCHEMA_MARK))
    nl = F.when(enough, strip(F.replace(F.get(parts, 2), F.lit(PROMPT_TAIL), F.lit(""))))
    return F.struct(text_or_empty(schema).alias("schema"), text_or_empty(nl).alias("nl"))


def input_fields(text: Column) -> Column:
    """(schema, nl) of a sample input; a missing second block gives a null nl."""
    parts = _blocks(text)
    return F.struct(
        _after_last(F.get(parts, 0), SCHEMA_MARK).alias("schema"),
        _before_first(F.get(parts, 1), "\n" + RESPONSE_MARK).alias("nl"),
    )


def question_fields(question: Column) -> Column:
    """(schema, nl) of a question that carries the schema marker, else two empty texts."""
    # A second marker ends the section that the first one opens.
    section = _before_first(_after_first(question, SCHEMA_MARK), SCHEMA_MARK)
    parts = _blocks(section)
    nl = strip(F.replace(F.get(parts, 1), F.lit(RESPONSE_MARK), F.lit("")))
    return F.struct(
        text_or_empty(F.get(parts, 0)).alias("schema"), text_or_empty(nl).alias("nl")
    )
