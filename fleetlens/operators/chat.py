"""Chat samples for fine-tuning, built from question tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.text import strip
from fleetlens.model import ALLOWED_VALUES, FOREIGN_KEYS, SCHEMAS

# What the business terms mean, as told to a model.
BUSINESS_TERMS = {
    "at-risk account": "an active customer with an active machine and no completed order "
    "in the last 180 days",
    "stale quote": "a quote in status sent whose sent_date is more than 45 days back",
    "service penetration": "active contracts on active machines as a percentage of active "
    "machines, per customer",
    "high-value account": "a customer in the top 20% by lifetime value of completed orders",
    "cross-sell candidate": "a customer with active machines and no active contract",
    "churn signal": "fewer completed orders in the last 6 months than in the 6 before",
    "expansion potential": "active machines times one minus the share under contract",
    "active account": "a customer with a completed order in the last 12 months",
    "revenue at risk": "completed order value of the last 12 months of at-risk accounts",
}


def _table_text(name: str) -> str:
    parents = {c: parent for t, c, parent in FOREIGN_KEYS if t == name}
    lines = []
    for field in SCHEMAS[name].fields:
        notes = [field.dataType.simpleString()]
        if (name, field.name) in ALLOWED_VALUES:
            notes.append("one of " + ", ".join(ALLOWED_VALUES[name, field.name]))
        if field.name in parents:
            notes.append(f"refers to {parents[field.name]}.id")
        if field.nullable and field.name not in parents:
            notes.append("may be null")
        lines.append(f"  {field.name}: {'; '.join(notes)}")
    return "\n".join([f"Table {name}", *lines])


def system_prompt(as_of: date) -> str:
    """Schema, business terms and the day, rendered from the model's own definitions."""
    tables = "\n\n".join(_table_text(name) for name in SCHEMAS)
    terms = "\n".join(f"- {term}: {meaning}" for term, meaning in BUSINESS_TERMS.items())
    return (
        "Answer business questions with one Spark SQL query over the tables below. "
        f"Reply with the query alone.\n\nToday is {as_of.isoformat()}.\n\n"
        f"{tables}\n\nTerms\n{terms}"
    )


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def prompt_rows(questions: DataFrame, prompt: str) -> DataFrame:
    """prompt = [system, user] and the trimmed truth; `questions` has question and sql."""
    return questions.withColumn(
        "prompt",
        F.array(_message("system", F.lit(prompt)), _message("user", F.col("question"))),
    ).withColumn("ground_truth_sql", strip(F.col("sql")))


def supervised_rows(questions: DataFrame, prompt: str) -> DataFrame:
    """messages = [system, user, assistant]; `questions` has question and sql."""
    return questions.withColumn(
        "messages",
        F.array(
            _message("system", F.lit(prompt)),
            _message("user", F.col("question")),
            _message("assistant", strip(F.col("sql"))),
        ),
    )


def exchanges(turns: DataFrame) -> DataFrame:
    """Question and answer pairs of a turn table: each user turn with the assistant turn
    right after it.  Turns meet by number, so a conversation of any length spreads out.
    """
    asked = turns.filter(F.col("role") == "user").select(
        "conv_id", (F.col("turn") + 1).alias("reply_turn"), F.col("text").alias("question")
    )
    replies = turns.filter(F.col("role") == "assistant").select(
        F.col("conv_id").alias("reply_conv"), "turn", F.col("text").alias("sql")
    )
    return asked.join(
        replies, F.expr("conv_id = reply_conv AND reply_turn = turn")
    ).select("conv_id", "turn", "question", "sql")


def transcript(messages: str) -> Column:
    """A chat sample as one text, a line per message."""
    return F.array_join(
        F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n"
    )


def overlapping_questions(train: DataFrame, evaluation: DataFrame, *columns: str) -> DataFrame:
    """Training rows whose given text columns also occur, up to case and edge space, in
    the evaluation set.  Whole texts meet by their SHA-256, which keeps the shuffled
    evaluation side narrow."""
    def key(column: str) -> Column:
        return F.sha2(strip(F.lower(column)), 256)

    keys = [f"__{c}" for c in columns]
    known = evaluation.select(*[key(c).alias(f"__{c}") for c in columns]).distinct()
    return (
        train.withColumns({f"__{c}": key(c) for c in columns})
        .join(known, keys, "left_semi")
        .drop(*keys)
    )
