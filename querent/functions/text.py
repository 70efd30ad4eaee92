"""Text functions: canonical answers, cleaning, chunking, prompts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querent.model import UNABLE, UNABLE_PHRASES

#: Prefixes and suffixes of generated text that are removed once each, in this order.
GENERATED_PREFIXES = ("Rewritten question: ", "Rewritten Question: ", "Question: ", '"', "'")
GENERATED_SUFFIXES = ('"', "'", ".")
NUMBER = r"^[+-]?(([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?|nan|inf|infinity)$"
CHUNK = 350


def is_numeric(text: Column) -> Column:
    """Whether a text is a number once currency signs, commas, white space and closing percent signs and dots are gone."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[$€,\s]+", ""), "%+$", ""), r"\.+$", "")
    return F.lower(bare).rlike(NUMBER)


def refuses(answer: Column) -> Column:
    """Whether an answer is empty or holds a refusal phrase."""
    low = F.lower(answer)
    out = low == ""
    for phrase in UNABLE_PHRASES:
        out = out | F.contains(low, F.lit(phrase))
    return out


def canonical_answers(df: DataFrame, answer: str = "answer", classify: Callable[[DataFrame, str], DataFrame] | None = None, into: str = "answer_converted") -> DataFrame:
    """df with the canonical answer: refusals to one phrase, numbers as they are, other text by `classify`.

    classify gets only the rows whose answer no rule settles, so an expensive model sees nothing else; without
    it such answers stay. Null answers stay null.
    """
    settled = refuses(F.col(answer)) | is_numeric(F.col(answer)) | F.col(answer).isNull()
    ruled = F.when(refuses(F.col(answer)), UNABLE).otherwise(F.col(answer))
    if classify is None:
        return df.withColumn(into, ruled)
    easy = df.where(settled).withColumn(into, ruled)
    return easy.unionByName(classify(df.where(~settled), answer).withColumnRenamed("classified", into))


def clean_entity(text: Column) -> Column:
    """White space collapsed; characters outside words, white space, dots and hyphens dropped; blanks and hyphens stripped."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"(?U)[^\w\s.-]", ""), r"^[ -]+|[ -]+$", "")


def containment_form(text: Column) -> Column:
    """The form in which an answer is looked for in recognised text."""
    return F.lower(F.regexp_replace(text, r"[\s_]+", ""))


def clean_generated(text: Column) -> Column:
    """A model's rewritten question without its known prefixes and suffixes."""
    out = F.regexp_replace(text, r"^\s+|\s+$", "")
    for p in GENERATED_PREFIXES:
        out = F.regexp_replace(out, f"^{p}", "")
    for s in GENERATED_SUFFIXES:
        out = F.regexp_replace(out, rf"[{s}]\z", "")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def chunks(sentences: Column, longest: int = CHUNK) -> Column:
    """array<string>: sentences cut to `longest` characters: after semicolons and new lines, after commas as well
    if a part is still too long, and by length in the end. Cuts keep what they follow; a last empty part stays."""

    def parts(s: Column) -> Column:
        first = F.split(s, r"(?<=[;\n])", -1)
        second = F.split(s, r"(?<=[,;\n])", -1)
        pieces = F.when(F.exists(first, lambda p: F.length(p) > longest), second).otherwise(first)
        hard = lambda p: F.when(F.length(p) <= longest, F.array(p)).otherwise(F.transform(F.sequence(F.lit(0), F.ceil(F.length(p) / longest).cast("int") - 1), lambda i: F.substring(p, i * longest + 1, F.lit(longest))))
        return F.when(F.length(s) <= longest, F.array(s)).otherwise(F.flatten(F.transform(pieces, hard)))

    return F.flatten(F.transform(sentences, parts))


#: Lines of the prompts.
REFUSAL_LINES = "- If uncertain, return 'Unable to determine'\n- If you can't find the answer, return 'Unable to determine'"
ROLE = "You are an AI assistant specialized in analyzing document images"
TASK = "Your task is to answer questions about the document image content precisely."
CONCISE = "- Provide concise, focused answers (single word or short phrase preferred)"


def prompt(question: Column, ocr: Column | None = None, refusal_aware: bool = True) -> Column:
    """The prompt for a window, with recognised text where there is some."""
    bare = [f"{ROLE}. {TASK}", "", "Guidelines:", CONCISE, "- Base your answer solely on what you see in the image", *([REFUSAL_LINES] if refusal_aware else [])]
    without = F.concat(F.lit("\n".join(bare) + "\nQuestion: "), question)
    if ocr is None:
        return without
    head = f"{ROLE} and text. {TASK}\n\nFor this question, you have the following OCR text:\n"
    tail = ["", "", "Guidelines:", CONCISE, "- Base your answer on both the image and the provided OCR text", REFUSAL_LINES if refusal_aware else ""]
    with_text = F.concat(F.lit(head), ocr, F.lit("\n".join(tail) + "\nQuestion: "), question)
    return F.when(F.coalesce(ocr, F.lit("")) == "", without).otherwise(with_text)


def rewrite_prompt(original: Column, corrupted: Column, entities: Column) -> Column:
    """Asks for a corrupted question in good grammar that keeps its entities."""
    return F.concat(
        F.lit("Rewrite the question so that it reads well. Keep these terms as they are: "), entities_string(entities),
        F.lit("\nOriginal question: "), original, F.lit("\nQuestion to rewrite: "), corrupted, F.lit("\nRewritten question: "))


def entities_string(texts: Column) -> Column:
    """Texts of entities in one string."""
    return F.array_join(texts, ", ")


def sentences(text: Column) -> Column:
    """array<string>: a text cut at white space that follows a sentence's end (., ! or ?, maybe with closing quotes or brackets) and
    comes before a capital, a digit or an opening quote; white space at the cuts is dropped."""
    return F.split(F.regexp_replace(text, r"""([.!?]["')\]]*)\s+(?=["'(\[]?[\p{Lu}0-9])""", "$1\u0001"), "\u0001", -1)


def choice_prompt(question: Column, choices: list[Column], instruction: str) -> Column:
    """A multiple-choice prompt: question, choices and instruction on lines of their own."""
    return F.concat_ws("\n", question, *choices, F.lit(instruction))


def sft_text(instruction: Column, source: Column) -> Column:
    """Instruction and question in one text, without the image placeholder."""
    bare = F.trim(F.replace(F.coalesce(source, F.lit("")), F.lit("<image>"), F.lit("")).alias("x"))
    return F.concat_ws("\n", F.trim(F.coalesce(instruction, F.lit(""))), F.regexp_replace(bare, r"^\s+|\s+$", ""))


def parse_verdict(response: Column) -> Column:
    """The `answer`-like boolean text of a judge's JSON reply: code fences and a json tag are stripped; false by default."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(response), r"^```(json)?\s*|\s*```$", ""), r"^json\s*", "")
    parsed = F.from_json(bare, "struct<verification_result:string,answer:string>", {"mode": "PERMISSIVE"})
    return F.lower(F.coalesce(parsed["verification_result"], F.lit("false")))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)
