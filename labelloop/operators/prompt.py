"""Few-shot prompts (P4, P11, F25) and the task description they come from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloop.functions.labels import label_word
from labelloop.functions.text import clean_text, fill_template


@dataclass(frozen=True)
class TaskSpec:
    system: str
    question: str
    sentence_template: str        # one "{}" slot for the text
    words: tuple[str, ...]        # class index -> answer word

    @property
    def num_classes(self) -> int:
        return len(self.words)


# The movie-review sentiment task of the original labelling script
# (system prompt, question, sentence template and class words, verbatim).
MOVIE_REVIEW = TaskSpec(
    system=("You are a helpful assistant for the task of text classification on the MR (Movie Review) dataset. "
            "You reply with brief, to-the-point answers with no elaboration as truthfully as possible. "
            "MR (Movie Review) dataset  is used in sentiment-analysis experiments and this dataset contains "
            "movie-review documents labeled with respect to their overall sentiment polarity  (positive or "
            "negative). Your task is to a binary classification to classify a movie review as positive or "
            "negative according to their overall sentiment polarity. The category is divided into two types: "
            "'positive' and 'negative'."),
    question=("How do you feel about the sentiment polarity of the given movie review, is this positive or "
              "negative? please answer in a single line with 'positive' or 'negative'. You must answer with "
              "'positive' or 'negative', do not answer anything else."),
    sentence_template="Given a movie review: '{}'",
    words=("negative", "positive"),
)


def generic_task(num_classes: int) -> TaskSpec:
    """Task over classes named class0 .. class{C-1}."""
    words = tuple(f"class{i}" for i in range(num_classes))
    return TaskSpec(
        system=("You are a helpful assistant for text classification. Reply with one class name and "
                "nothing else. The classes are: " + ", ".join(words) + "."),
        question="Which class does the given text belong to? Answer with one class name only.",
        sentence_template="Given a text: '{}'",
        words=words,
    )


def sentence(task: TaskSpec, text) -> Column:
    """P3 + P4: newline-free text in the sentence template."""
    return fill_template(task.sentence_template, clean_text(text))


def _msg(role: str, content) -> Column:
    content = F.lit(content) if isinstance(content, str) else content
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def messages(task: TaskSpec, text, demo_texts, demo_answers) -> Column:
    """1 system message, 3 per demonstration (text, question, answer), then
    the text and the question: 33 messages for 10 demonstrations."""
    dt = F.col(demo_texts) if isinstance(demo_texts, str) else demo_texts
    da = F.col(demo_answers) if isinstance(demo_answers, str) else demo_answers
    demos = F.flatten(F.transform(
        F.arrays_zip(dt.alias("t"), da.alias("a")),
        lambda d: F.array(_msg("user", sentence(task, d["t"])), _msg("user", task.question),
                          _msg("assistant", d["a"]))))
    head = F.array(_msg("system", task.system))
    tail = F.array(_msg("user", sentence(task, text)), _msg("user", task.question))
    return F.concat(head, demos, tail)


def prompts_from_wide(wide: DataFrame, task: TaskSpec, *, id_col: str = "id", text_col: str = "text",
                      texts: str = "demo_texts", labels: str = "demo_labels") -> DataFrame:
    """(id, messages) straight from the wide retrieval rows that already carry
    the demos' texts and labels: a projection, no join and no shuffle."""
    answers = F.transform(F.col(labels), lambda lab: label_word(lab, task.words))
    return wide.select(id_col, messages(task, F.col(text_col), F.col(texts), answers).alias("messages"))


def build_prompts(rows: DataFrame, demos_long: DataFrame, corpus_text: DataFrame, task: TaskSpec, *,
                  id_col: str = "id", text_col: str = "text", answer_label: str = "demo_label") -> DataFrame:
    """(id, messages) from the query rows, their demonstrations in long form
    ``(id, pos, demo_id, demo_label)`` and the text table ``(id, text)``.

    Demo texts are joined by id (J3) - broadcast when the text table of the
    demonstrations is the small pool, a shuffle join otherwise - and the
    ordered lists are regrouped per query row."""
    texts = corpus_text.select(F.col(id_col).alias("demo_id"), F.col(text_col).alias("demo_text"))
    d = demos_long.join(texts, "demo_id", "left").withColumn(
        "answer", label_word(F.col(answer_label), task.words))
    per_row = (d.groupBy(id_col)
               .agg(F.array_sort(F.collect_list(F.struct("pos", "demo_text", "answer"))).alias("_d"))
               .select(id_col, F.transform("_d", lambda x: x["demo_text"]).alias("demo_texts"),
                       F.transform("_d", lambda x: x["answer"]).alias("demo_answers")))
    q = rows.select(id_col, text_col).join(per_row, id_col, "left")
    q = q.withColumn("demo_texts", F.coalesce("demo_texts", F.array().cast("array<string>"))) \
         .withColumn("demo_answers", F.coalesce("demo_answers", F.array().cast("array<string>")))
    return q.select(id_col, messages(task, F.col(text_col), "demo_texts", "demo_answers").alias("messages"))


def exploded_messages(prompts: DataFrame, id_col: str = "id") -> DataFrame:
    """Prompt in the long chat-log shape ``(id, turn, role, content)``."""
    return prompts.select(id_col, F.posexplode("messages").alias("turn", "m")).select(
        id_col, F.col("turn").cast("bigint").alias("turn"), F.col("m.role").alias("role"),
        F.col("m.content").alias("content"))
