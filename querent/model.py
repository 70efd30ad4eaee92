"""Schemas and fixed dimensions of the question-answering model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entity label to macro entity.
MACRO_ENTITIES = {
    "NUMERIC": ("numerical_value_number", "measure_unit", "price_number_information", "price_numerical_value", "percentage", "temperature", "currency"),
    "TEMPORAL": ("date_information", "date_numerical_value", "time_information", "time_numerical_value", "year_number_information", "year_numerical_value"),
    "ENTITY": ("person_name", "company_name", "event", "product", "food", "chemical_element", "job_title_name", "job_title_information", "animal", "plant", "movie", "book", "transport_means"),
    "LOCATION": ("country", "city", "street", "spatial_information", "continent", "postal_code_information", "postal_code_numerical_value"),
    "STRUCTURE": ("document_position_information", "page_number_information", "page_number_numerical_value", "document_element_type", "document_element_information", "document_structure_information"),
}
#: Layout types, and those of them that are visual.
LAYOUT_TYPES = ("title", "plain text", "abandon", "figure", "figure_caption", "table", "table_caption", "table_footnote", "isolate_formula", "formula_caption")
VISUAL_TYPES = ("figure", "table", "isolate_formula")
#: Quadrants of a page.
QUADRANTS = ("TOP_LEFT", "TOP_RIGHT", "BOTTOM_LEFT", "BOTTOM_RIGHT")
#: The least score of a label that counts (exclusive), and that of other labels.
LABEL_THRESHOLDS = {
    "document_position_information": 0.75, "page_number_information": 0.75, "page_number_numerical_value": 0.8,
    "document_element_type": 0.8, "document_element_information": 0.8, "document_structure_information": 0.8,
    "postal_code_information": 0.8, "postal_code_numerical_value": 0.78, "date_information": 0.75,
    "year_numerical_value": 0.7, "job_title_information": 0.8, "job_title_name": 0.9,
}
DEFAULT_THRESHOLD = 0.75
#: An answer that holds one of these refuses.
UNABLE_PHRASES = (
    "unable to determine", "not answerable", "not provided", "not available", "not in the image", "not in the document",
    "not found", "not contain", "not include", "cannot determine", "cannot answer", "cannot provide", "cannot find",
    "i don ' t know", "i don't know", "unknown",
)
UNABLE = "unable to determine"
COMPLEXITIES = (1, 2, 3)

BOX = "array<int>"
ENTITY = "struct<text:string,label:string,score:double,start:int,end:int>"
LAYOUT_OBJECT = "struct<BBOX:array<int>,ObjectType:string,ObjectTypeID:string,OCR:string,PatchPath:string>"
LAYOUT = f"struct<pages:map<string,struct<image_path:string,layout_analysis:map<string,{LAYOUT_OBJECT}>>>>"
PATCH_ENTITIES = f"map<string,map<string,struct<bbox:{BOX},type:string,typeID:string,entities:array<{ENTITY}>>>>"
WINDOW_ANSWERS = "array<struct<pages:array<string>,answer:string,answer_converted:string>>"
VQA_RESULT = (
    "struct<model_type:string,ocr_enabled:boolean,analysis_type:string,timestamp:string,question_corrupted:string,question_clean:string,"
    f"answer_corrupted:{WINDOW_ANSWERS},answer_clean:{WINDOW_ANSWERS}>"
)
#: A corrupted question with its document, layout, entities, verdict and answers. Values of another type read as null.
RECORD = (
    "corrupted_question string, original_question string, complexity int, is_corrupted boolean, "
    f"question_entities array<struct<text:string,positions:array<struct<page_id:string,object_id:string,object_bbox:{BOX},entity_text:string,label:string,score:double,start:int,end:int>>>>, "
    f"original_entity array<struct<text:string,page_id:string,bbox:{BOX},obj_id:string,answer:string,layout_type:string,entity_type:string,label:string>>, "
    f"corrupted_entities array<struct<text:string,page_id:string,bbox:{BOX},obj_id:string,objectType:string,layout_type_id:string,label:string>>, "
    "entity_type array<string>, "
    f"original_answer_locations array<struct<page_id:string,object_type:string,object_typeID:string,bbox:{BOX},answer:string>>, "
    f"patch_entities {PATCH_ENTITIES}, layout_analysis {LAYOUT}, "
    f"verification_result struct<verification_result:string,question_answer:string,image_path:string,vqa_results:array<{VQA_RESULT}>>"
)
#: One question of any source dataset.
STANDARD = "questionId string, question string, answers array<string>, answer_page_idx int, data_split string, docId string, document array<string>"


def macro_entities(spark: SparkSession) -> DataFrame:
    """(label, macro)."""
    return spark.createDataFrame([(label, macro) for macro, labels in MACRO_ENTITIES.items() for label in labels], "label string, macro string")


def layout_kinds(spark: SparkSession) -> DataFrame:
    """(layout_type, kind): kind is vre for visual types, else text."""
    return spark.createDataFrame([(t, "vre" if t in VISUAL_TYPES else "text") for t in LAYOUT_TYPES], "layout_type string, kind string")


def thresholds(spark: SparkSession) -> DataFrame:
    """(label, threshold)."""
    return spark.createDataFrame(list(LABEL_THRESHOLDS.items()), "label string, threshold double")


def require_mapped(df: DataFrame, column: str, mapped: str) -> DataFrame:
    """df, failing at run time with the value when `mapped` is null where `column` is not: unmapped labels are errors, not lost rows."""
    bad = F.col(column).isNotNull() & F.col(mapped).isNull()
    return df.withColumn(mapped, F.when(bad, F.raise_error(F.concat(F.lit(f"no mapping for {column} "), F.col(column).cast("string"))).cast("string")).otherwise(F.col(mapped)))
