"""The verb lexicon and the dictionary, built from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions.xmljson import xml_column
from tidegraph.operators.nested import flatten
from tidegraph.session import cut

#: The names of verb types by number; 65, 67 and 89 are no longer in use.
TYPE_NAMES = {
    9: "verbs_of_putting", 10: "verbs_of_removing", 11: "verbs_of_sending_and_carrying", 12: "verbs_of_exerting_force-push-pull_verbs",
    13: "verbs_of_change_of_possession", 14: "learn_verbs", 15: "hold_and_keep_verbs", 16: "verbs_of_concealment", 17: "verbs_of_throwing",
    18: "verbs_of_contact_by_impact", 19: "poke_verbs", 20: "verbs_of_contact-touch_verbs", 21: "verbs_of_cutting", 22: "verbs_of_combining_and_attaching",
    23: "verbs_of_separating_and_disassembling", 24: "verbs_of_coloring", 25: "image_creation_verbs", 26: "verbs_of_creation_and_transformation",
    27: "engender_verbs", 28: "calve_verbs", 29: "verbs_with_predicative_complements", 30: "verbs_of_perception",
    31: "psych-verbs-verbs_of_psychological_state", 32: "verbs_of_desire", 33: "judgment_verbs", 34: "verbs_of_assessment", 35: "verbs_of_searching",
    36: "verbs_of_social_interaction", 37: "verbs_of_communication", 38: "verbs_of_sounds_made_by_animals", 39: "verbs_of_ingesting",
    40: "verbs_involving_the_body", 41: "verbs_of_grooming_and_bodily_care", 42: "verbs_of_killing", 43: "verbs_of_emission", 44: "destroy_verbs",
    45: "verbs_of_change_of_state", 46: "lodge_verbs", 47: "verbs_of_existence", 48: "verbs_of_appearance_disappearance_and_occurrence",
    49: "verbs_of_body-internal_motion", 50: "verbs_of_assuming_a_position", 51: "verbs_of_motion", 52: "avoid_verbs",
    53: "verbs_of_lingering_and_rushing", 54: "measure_verbs", 55: "aspectual_verbs", 56: "weekend_verbs", 57: "weather_verbs",
    58: "verbs_of_urging_and_begging", 59: "force_verbs", 60: "attack_verbs", 61: "try_verbs", 62: "wish_verbs", 63: "enforce_verbs", 64: "allow_verbs",
    66: "consume_verbs", 68: "pay_verbs", 69: "refrain_verbs", 70: "rely_verbs", 71: "conspire_verbs", 72: "help_verbs", 73: "cooperate_verbs",
    74: "succeed_verbs", 75: "neglect_verbs", 76: "limit_verbs", 77: "approve_verbs", 78: "indicate_verbs", 79: "dedicate_verbs", 80: "free_verbs",
    81: "suspect_verbs", 82: "withdraw_verbs", 83: "cope_verbs", 84: "discover_verbs", 85: "cognize_verbs", 86: "verbs_of_correlating_and_relating",
    87: "verbs_of_focusing_and_comprehending", 88: "verbs_of_caring_and_empathizing", 90: "exceed_verbs", 91: "matter_verbs", 92: "confine_verbs",
    93: "adopt_verbs", 94: "risk_verbs", 95: "acquiesce_verbs", 96: "addict_verbs", 97: "verbs_of_basing_and_deducing", 98: "confront_verbs",
    99: "ensure_verbs", 100: "own_verbs", 101: "patent_verbs", 102: "promote_verbs", 103: "require_verbs", 104: "verbs_of_spending_time", 105: "use_verbs",
    106: "void_verbs", 107: "involve_verbs", 108: "multiply_verbs", 109: "seem_verbs", 110: "representation_verbs", 111: "conduct_verbs",
    112: "reciprocate_verbs", 113: "respond_verbs", 114: "act_verbs",
}
#: Verbs that help others.
HELPING = ("be", "have", "do", "shall", "will", "wo", "should", "would", "may", "might", "must", "can", "could", "ought", "dare", "need")


def read_class_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, record_xml) of a folder of XML files."""
    return spark.read.text(folder, wholetext=True, pathGlobFilter="*.xml").select(
        F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file_name"), F.col("value").alias("record_xml")
    )


def build_lexicon(files: DataFrame) -> DataFrame:
    """(verb, classes, type_name, type_id) of (file_name, record_xml): members of classes and of their
    first subclasses, deeper ones not; one row per verb with sorted distinct lists. The class is the
    file's name up to the first hyphen, the type the number behind it, null names for unknown types.
    Helping verbs get one class more. Null and malformed files are left out.
    """
    keep = ("VNCLASS", "VNSUBCLASS", "SUBCLASSES", "MEMBERS", "MEMBER")
    stem = F.split("file_name", r"\.xml")[0]
    named = files.select(
        "file_name",
        F.split(stem, "-")[0].alias("class"),
        F.get(F.split(stem, r"-|\."), F.lit(1)).alias("type_id"),
        xml_column(F.col("record_xml"), keep).alias("json"),
    )
    records = cut(named.where(F.col("json").isNotNull()).distinct())
    flat = flatten(records, "file_name", "json", tables={"MEMBER"})
    helping = files.sparkSession.createDataFrame([(v,) for v in HELPING], "verb string").select(
        "verb", F.lit("helping_verbs").alias("class"), F.lit("helping_verbs").alias("type_name"), F.lit("0").alias("type_id")
    )
    if "MEMBER" not in flat:
        rows = helping
    else:
        near = flat["MEMBER"].where(F.col("parent").rlike(r"^VNCLASS\.\d+\.(?:SUBCLASSES\.\d+\.VNSUBCLASS\.\d+\.)?MEMBERS\.\d+$"))
        names = F.create_map(*[F.lit(x) for k, v in TYPE_NAMES.items() for x in (str(k), v)])
        rows = (
            near.select("file_name", F.col("@name").alias("verb"))
            .where(F.col("verb").isNotNull())
            .join(records.select("file_name", "class", "type_id").distinct(), "file_name")
            .select("verb", "class", names[F.col("type_id")].alias("type_name"), "type_id")
            .unionByName(helping)
        )
    lists = [F.array_sort(F.collect_set(c)).alias(n) for c, n in (("class", "classes"), ("type_name", "type_name"), ("type_id", "type_id"))]
    return rows.groupBy("verb").agg(*lists)


def read_dictionary(spark: SparkSession, folder: str, most: int = 60, encoding: str = "ISO-8859-1") -> DataFrame:
    """(word) of word-list files whose ending is a number of at most ``most``."""
    files = spark.read.format("binaryFile").load(folder)  # the text source reads UTF-8 only
    lines = files.select(F.explode(F.split(F.decode("content", encoding), r"\r?\n")).alias("value"), F.try_to_number(F.regexp_extract("path", r"\.(\d+)$", 1), F.lit("999")).alias("size"))
    return lines.where((F.col("size") <= most) & (F.trim("value") != "")).select(F.trim("value").alias("word")).distinct()
