"""Public question datasets as canonical questions: one function each, from its raw tables.

Raw tables come from the readers in ``files`` or any other; pictures are named, not read: where a rule needs a
picture's size, the raw table has ``width`` and ``height``. All functions give the columns of ``CANON``. Options are
(id, text, box), targets (bool, ids), and what only one dataset has is JSON in ``quality``.

Defined cases: rows with a null id are left out; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marlstone.functions.hashing import byte_mod
from marlstone.operators import nesting as nest
from marlstone.plans.lineage import cut

OPTION = "struct<id:string,text:string,box:array<double>>"
CANON = (
    "sample_id", "root_id", "group_id", "source", "source_version", "license", "split", "task_type", "image", "state_text", "question",
    "allowed_history", "input_track", "options", "candidates", "target_kind", "target", "label_origin", "origin_label_method", "evidence_reference",
    "generator_version", "proposal_kind", "quality", "schema_version", "source_bucket", "language", "generator_revision", "teacher_only"
)
# Answers that make a question one of yes or no.
YES, NO = ("yes", "true"), ("no", "false")
# How datasets call their splits.
SPLITS = {"train": "train", "val": "dev", "test": "test"}

# What is the same for all questions of a dataset.
FACTS = {
    "vqav2": {"source": "vqav2", "source_version": "v2", "license": "VQAv2/COCO-upstream-terms"},
    "textvqa": {"source": "textvqa", "source_version": "0.5.1", "license": "CC-BY-4.0"},
    "gqa": {"source": "gqa", "source_version": "1.2-balanced", "license": "GQA/upstream-image-terms", "label_origin": "programmatic", "origin_label_method": "programmatic_from_scene_graph"},
    "clevr": {"source": "clevr", "source_version": "1.0", "license": "CC-BY-4.0", "label_origin": "programmatic", "origin_label_method": "programmatic_scene_generator"},
    "chartqa": {"source": "chartqa", "source_version": "af8b6f5c08c95085271561c2a3f9d15f2b5a9031", "license": "ChartQA/GPL-3.0-review-required"},
    "mnli": {"source": "multi_nli", "source_version": "pinned-hf-da70db2", "license": "MNLI/mixed-upstream-terms", "origin_label_method": "human_consensus", "input_track": "text_only", "generator_version": "mnli-v2"},
    "nlvr": {"source": "nlvr", "source_version": "git-18924841", "license": "CC-BY-4.0", "origin_label_method": "human_consensus", "generator_version": "nlvr-v1"},
    "visual7w": {"source": "visual7w", "source_version": "pointing", "license": "Visual7W/underlying-image-terms", "origin_label_method": "human_multiple_choice_grounding", "generator_version": "visual7w-pointing-v1", "proposal_kind": "oracle"},
    "scienceqa": {"source": "scienceqa", "source_version": "git-2cbf8318", "license": "CC-BY-NC-SA-4.0", "origin_label_method": "upstream_multiple_choice_label", "generator_version": "scienceqa-v1"},
    "gui_odyssey": {"question": "Which recorded action should be taken next to complete this task?", "source": "gui_odyssey", "source_version": "hf-71e0e7e2", "license": "CC-BY-4.0", "origin_label_method": "upstream_demonstration_action", "input_track": "high_level_goal_pure_visual", "generator_version": "gui-odyssey-v1"},
    "koniq10k": {"question": "Rate the dataset-relative perceptual quality of this image.", "source": "koniq10k", "source_version": "koniq-10k-1024x768", "license": "KonIQ-10k/research-use", "origin_label_method": "derived_train_mos_quintile_from_upstream_ratings", "generator_version": "koniq10k-v1", "target_kind": "ordinal_train_mos_quintile_5"},
    "refcoco": {"source_version": "pinned-hf-mirror", "license": "RefCOCO/COCO-upstream-terms", "origin_label_method": "human_referring_expression", "input_track": "oracle_region_candidates", "generator_version": "refcoco-oracle-adapter-v2", "proposal_kind": "oracle"},
    "mind2web": {"question": "Select the next interface element to act on.", "source": "multimodal_mind2web", "source_version": "1b4c6a8cf9f77b7a5e0d641959935c80c4a05889", "license": "OpenRAIL/research-disclaimer", "origin_label_method": "human_action_demonstration", "input_track": "high_level_goal_visual_dom_candidates", "generator_version": "mind2web-adapter-v2", "proposal_kind": "dom"},
    "android_control": {"question": "Select the next action for the high-level goal.", "source": "android_control", "source_version": "ca530e89dfc3b1a4c3d9bd30fd36be94536563b1", "license": "AndroidControl/Apache-2.0-mirror-review-required", "origin_label_method": "human_action_demonstration", "input_track": "high_level_goal_pure_visual", "generator_version": "android-control-adapter-v2", "proposal_kind": "accessibility_tree"},
    "weblinx": {"question": "Select the next webpage element to act on.", "source": "weblinx", "source_version": "36ef9f79b43df50e25b7f3b68e5c9f6ccf4160e8", "license": "CC-BY-NC-SA-4.0/fair-use", "origin_label_method": "human_dialogue_navigation", "input_track": "dialogue_visual_region_candidates", "generator_version": "weblinx-adapter-v2", "proposal_kind": "dom"},
}

text = F.lit
no_options = lambda: F.array().cast(f"array<{OPTION}>")


def facts(dataset: str) -> dict[str, Column]:
    """The fixed fields of a dataset, as columns."""
    return {k: F.lit(v) for k, v in FACTS[dataset].items()}


def option(id_: Column, label: Column, box: Column | None = None) -> Column:
    """One option."""
    return F.struct(id_.alias("id"), label.alias("text"), (F.lit(None) if box is None else box).cast("array<double>").alias("box")).cast(OPTION)


def corners(x: Column, y: Column, width: Column, height: Column) -> Column:
    """A box by its corners instead of its size."""
    return F.array(x, y, x + width, y + height).cast("array<double>")


def canonical(rows: DataFrame, **fields: Column) -> DataFrame:
    """The canonical columns of rows; what isn't given has the usual value."""
    usual = {
        "root_id": fields["group_id"], "state_text": text(""), "allowed_history": F.array().cast("array<string>"), "input_track": text("pure_visual"), "options": no_options(), "label_origin": text("human"), "origin_label_method": text("human"),
        "image": F.lit(None).cast("string"), "proposal_kind": text("none"), "quality": text("{}"), "schema_version": F.lit(2), "source_bucket": text("public"), "language": text("en"), "generator_revision": text("canonical"), "teacher_only": F.lit(False), "generator_version": text("canonical-v1"),
    }
    got = {**usual, **fields}
    target = got["target"]
    got["candidates"] = got["options"]
    got["target_kind"] = got.get("target_kind", F.when(got["task_type"] == "noul", "binary").otherwise("single"))
    got["target"] = F.when(
        got["task_type"] == "noul", F.struct((target == "true").alias("bool"), F.array().cast("array<string>").alias("ids"))
    ).otherwise(F.struct(F.lit(None).cast("boolean").alias("bool"), F.array(target).alias("ids")))
    return rows.where(fields["sample_id"].isNotNull()).select(*[got[c].alias(c) for c in CANON])


def hashed(values: Column, key: Column) -> Column:
    """Values in the order of the hash of ``key:value``."""
    return nest.hashed_order(values, key)


def by_hash(options: Column, key: Column, sep: str = ":") -> Column:
    """Options in the order of the hash of key and id."""
    ranked = F.transform(options, lambda o: F.struct(F.sha2(F.concat(key, F.lit(sep), o["id"]), 256).alias("h"), o.alias("o")))
    return F.transform(F.array_sort(ranked), lambda x: x["o"])


def capped(options: Column, target: Column, key: Column, most: int, sep: str) -> Column:
    """At most ``most`` options: the targets (an array of ids), then others in the order of their hash."""
    right = F.filter(options, lambda o: F.array_contains(target, o["id"]))
    other = F.filter(options, lambda o: ~F.array_contains(target, o["id"]))
    return F.slice(F.concat(by_hash(right, key, sep), by_hash(other, key, sep)), 1, most)


def last_of_each(options: Column) -> Column:
    """Options with repeated ids merged: the place of the first, the value of the last."""
    ids = F.array_distinct(F.transform(options, lambda o: o["id"]))
    return F.transform(ids, lambda i: F.element_at(F.filter(options, lambda o: o["id"] == i), -1))


def one_of_each(rows: DataFrame, key: str) -> DataFrame:
    """One row of each key: the least by its other columns, whatever the order of the rows."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min(F.struct(*rest)).alias("_one")).select(key, "_one.*")


def compact(*fields: Column) -> Column:
    """Fields as JSON, nulls included."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def open_questions(rows: DataFrame, pool: list[str], members: DataFrame | None = None, fallback: bool = True, **fields: Column) -> DataFrame:
    """Questions with a free answer: yes and no become a noul, others a choice among hard negatives.

    rows: sample_id (unique), split, question, answer and the columns of ``pool``, by which negatives are compatible.
    Options are the answer and its negatives in hashed order; a question without any negative is left out. pool is
    ``['split', 'kind', 'family']`` for pools by kind of answer and family of question, which are computed here.
    """
    a = rows.where(F.col("sample_id").isNotNull() & F.col("answer").isNotNull()).withColumn("answer", nest.normalized("answer"))
    if pool == ["split", "kind", "family"]:
        kinds = lambda df: df.withColumn("kind", nest.answer_kind(F.col("answer"))).withColumn(
            "family", nest.question_family(F.coalesce("question", F.lit("")))
        )
        a = kinds(a)
        members = None if members is None else kinds(members.where("answer is not null").withColumn("answer", nest.normalized("answer")))
    a = cut(a)
    wrong = nest.negatives(a, pool, members=members, fallback=fallback).select("sample_id", "negatives")
    a = a.join(wrong, "sample_id").withColumn("noul", F.col("answer").isin(*YES, *NO)).where("noul or size(negatives) > 0")
    ordered = hashed(F.concat(F.array("answer"), "negatives"), F.col("sample_id"))
    a = a.withColumn("_values", ordered)
    options = F.transform("_values", lambda v, i: option(F.concat(F.lit("option_"), i.cast("string")), v))
    place = F.concat(F.lit("option_"), (F.array_position("_values", F.col("answer")) - 1).cast("string"))
    noul = F.col("noul")
    target = F.when(noul, F.col("answer").isin(*YES).cast("string")).otherwise(place)
    return canonical(
        a, sample_id=F.col("sample_id"), split=F.col("split"), question=F.col("question"), task_type=F.when(noul, "noul").otherwise("choice"),
        options=F.when(noul, no_options()).otherwise(options), target=target, **fields
    )


def agreed(answers: Column) -> Column:
    """(answer, votes): the answer most annotators gave, normalized; the first given of equally frequent ones."""
    clean = F.transform(answers, nest.normalized)
    votes = F.transform(
        F.array_distinct(clean), lambda v, i: F.struct(F.size(F.filter(clean, lambda x: x == v)).alias("votes"), (-i).alias("i"), v.alias("answer"))
    )
    return F.array_max(votes)


def vqav2(questions: DataFrame, annotations: DataFrame, images: str = "images") -> DataFrame:
    """questions: question_id, image_id, question, split (train or val). annotations: question_id, answers array<struct<answer>>.

    A question without an annotation is an error; answers need eight equal votes.
    """
    a = annotations.select("question_id", F.transform("answers", lambda x: x["answer"]).alias("answers"))
    j = questions.where("question_id is not null").join(a, "question_id", "left").withColumn(
        "answers",
        F.when(
            F.col("answers").isNull(),
            F.raise_error(F.concat(F.lit("no annotation of question "), F.col("question_id").cast("string"))).cast("array<string>")
        ).otherwise(F.col("answers"))
    )
    j = j.withColumn("best", agreed(F.col("answers"))).where("best.votes >= 8")
    j = j.select(
        F.concat(F.lit("vqav2:"), F.col("question_id").cast("string")).alias("sample_id"),
        F.when(F.col("split") == "train", "train").otherwise("dev").alias("split"), "question", F.col("best.answer").alias("answer"), "image_id",
        "question_id", F.col("best.votes").alias("votes")
    )
    folder = F.when(F.col("split") == "train", "train2014").otherwise("val2014")
    image = F.concat(
        F.lit(f"{images}/coco_"), folder, F.lit("/"), folder, F.lit("/COCO_"), folder, F.lit("_"), F.lpad(F.col("image_id").cast("string"), 12, "0"),
        F.lit(".jpg")
    )
    return open_questions(
        j, ["split", "kind", "family"], group_id=F.concat(F.lit("coco:"), F.col("image_id").cast("string")), image=image,
        evidence_reference=F.concat(F.lit("question_id:"), F.col("question_id").cast("string")),
        quality=compact(F.col("votes").alias("answer_agreement"), F.lit(8).alias("minimum_required")), **facts("vqav2")
    )


def textvqa(rows: DataFrame, images: str = "images") -> DataFrame:
    """rows: question_id, image_id, question, answers array<string>, split (train or val)."""
    j = rows.where("question_id is not null").withColumn("best", agreed(F.col("answers"))).where("best.votes >= 8")
    j = j.select(
        F.concat(F.lit("textvqa:"), F.col("question_id").cast("string")).alias("sample_id"),
        F.when(F.col("split") == "train", "train").otherwise("dev").alias("split"), "question", F.col("best.answer").alias("answer"), "image_id",
        "question_id", F.col("best.votes").alias("votes")
    )
    return open_questions(
        j, ["split", "kind", "family"], group_id=F.concat(F.lit("openimages:"), "image_id"),
        image=F.concat(F.lit(f"{images}/"), "image_id", F.lit(".jpg")),
        evidence_reference=F.concat(F.lit("question_id:"), F.col("question_id").cast("string")),
        quality=compact(F.col("votes").alias("answer_agreement"), F.lit(8).alias("minimum_required"), F.lit(True).alias("ocr_excluded_from_input")),
        **facts("textvqa")
    )


def gqa(rows: DataFrame, images: str = "images") -> DataFrame:
    """rows: key (the question id), question, answer, imageId, split (train or val), and semantic as JSON if there is one."""
    semantic = F.coalesce("semantic", F.lit("[]")) if "semantic" in rows.columns else F.lit("[]")
    j = rows.where("key is not null").select(
        F.concat(F.lit("gqa:"), "key").alias("sample_id"), F.when(F.col("split") == "train", "train").otherwise("dev").alias("split"), "question",
        "answer", "imageId", semantic.alias("semantic")
    )
    return open_questions(
        j, ["split", "kind", "family"], group_id=F.concat(F.lit("gqa-image:"), "imageId"),
        image=F.concat(F.lit(f"{images}/"), "imageId", F.lit(".jpg")), evidence_reference=F.concat(F.lit("semantic:"), "semantic"),
        quality=compact(F.lit(True).alias("balanced_split"), F.lit(True).alias("negative_requires_scene_graph_audit")), **facts("gqa")
    )


def clevr(rows: DataFrame, images: str = "images") -> DataFrame:
    """rows: question_index, image_filename, question, answer, program array<struct<function>>, split (train or val).

    Negatives have the same last function of their program; a small pool is not widened.
    """
    program = F.get("program", F.size("program") - 1)["function"]
    j = rows.where("question_index is not null").select(
        F.concat_ws(":", F.lit("clevr"), "split", F.col("question_index").cast("string")).alias("sample_id"),
        F.when(F.col("split") == "train", "train").otherwise("dev").alias("split"), F.coalesce(program, F.lit("other")).alias("function"), "question",
        "answer", "image_filename", "question_index", F.col("split").alias("given")
    )
    return open_questions(
        j, ["split", "function"], fallback=False, group_id=F.concat(F.lit("clevr:"), "image_filename"),
        image=F.concat_ws("/", F.lit(images), "given", "image_filename"),
        evidence_reference=F.concat(F.lit("program:"), F.col("question_index").cast("string")), **facts("clevr")
    )


def chartqa(rows: DataFrame, images: str = "images") -> DataFrame:
    """rows: file, row (its number in the file), image (bytes), query, label, imgname, type.

    Files of test questions are left out. A picture that any file of development questions has is in dev wherever it
    stands; pools of answers follow the files, and are looked up by the picture's split.
    """
    r = rows.where(~F.col("file").contains("test")).withColumn(
        "given", F.when(F.col("file").contains("train"), "train").otherwise("dev")
    ).withColumn("digest", F.sha2("image", 256)).drop("image")
    r = cut(r.select("file", "row", "digest", "query", "label", "imgname", F.lower(F.coalesce("type", F.lit(""))).alias("type"), "given"))
    split = r.groupBy("digest").agg(F.min("given").alias("split"))  # dev before train
    key = F.substring(F.sha2(F.concat_ws("\u0000", "file", F.col("row").cast("string"), "imgname", "query", "label"), 256), 1, 20)
    j = r.join(split, "digest").select(
        F.concat(F.lit("chartqa:"), key).alias("sample_id"), "split", F.col("query").alias("question"), F.col("label").alias("answer"), "digest",
        "imgname", "row", "type"
    )
    members = r.select(F.col("given").alias("split"), F.col("query").alias("question"), F.col("label").alias("answer"))
    human = F.col("type") == "human"
    return open_questions(
        j, ["split", "kind", "family"], members=members, group_id=F.concat(F.lit("chartqa-image:"), "digest"),
        image=F.concat(F.lit(f"{images}/"), "digest", F.lit(".png")), label_origin=F.when(human, "human").otherwise("programmatic"),
        origin_label_method=F.when(human, "human").otherwise("augmented"),
        evidence_reference=F.concat(F.lit("image:"), "imgname", F.lit(":row:"), F.col("row").cast("string")),
        quality=compact(
            F.col("type").alias("question_origin"), F.lit(True).alias("table_excluded_from_input"),
            F.lit(True).alias("answer_requires_table_verification")
        ),
        **facts("chartqa")
    )


def mnli(rows: DataFrame) -> DataFrame:
    """rows: file, row (its number in the file), pairID, premise, hypothesis, label. The first split of a pair, by file and row, keeps it."""
    r = rows.where("pairID is not null and label in (0, 1, 2)").withColumn("split", F.when(F.col("file").contains("train"), "train").otherwise("dev"))
    first = r.groupBy("pairID").agg(F.min_by("split", F.struct("file", "row")).alias("_first"))
    r = r.join(first, "pairID").where("split = _first")
    labels = ("entailment", "neutral / insufficient information", "contradiction")
    stem = F.regexp_replace(F.regexp_extract("file", r"([^/]*)$", 1), r"\.[^.]*$", "")
    group = F.concat(F.lit("mnli:"), "pairID")
    return canonical(
        r, sample_id=F.concat_ws(":", F.lit("mnli"), stem, F.col("row").cast("string"), "pairID"), group_id=group, split=F.col("split"),
        task_type=text("choice"), state_text=F.col("premise"), question=F.col("hypothesis"),
        options=F.array(*[option(text(f"label_{i}"), text(v)) for i, v in enumerate(labels)]),
        target=F.concat(F.lit("label_"), F.col("label").cast("string")), evidence_reference=F.concat(F.lit("pairID:"), "pairID"), **facts("mnli")
    )


def nlvr(rows: DataFrame, images: str = "images") -> DataFrame:
    """rows: identifier, directory, sentence, label, split (train or dev), evals as JSON if there is one. Each has six pictures."""
    r = rows.where("identifier is not null").withColumn("permutation", F.explode(F.array(*[F.lit(str(i)) for i in range(6)])))
    group = F.concat_ws(":", F.lit("nlvr"), "split", "identifier")
    name = F.concat(F.concat_ws("-", "split", "identifier", "permutation"), F.lit(".png"))
    evals = F.coalesce("evals", F.lit("{}")) if "evals" in rows.columns else F.lit("{}")
    return canonical(
        r, sample_id=F.concat_ws(":", group, "permutation"), group_id=group, split=F.col("split"), task_type=text("noul"),
        image=F.concat_ws("/", F.lit(images), "split", F.lit("images"), F.col("directory").cast("string"), name), question=F.col("sentence"),
        target=(nest.normalized("label") == "true").cast("string"), evidence_reference=F.concat(F.lit("identifier:"), "identifier"),
        quality=F.concat(F.lit('{"upstream_evals":'), evals, F.lit("}")), **facts("nlvr")
    )


def visual7w(images: DataFrame, boxes: DataFrame, folder: str = "images") -> DataFrame:
    """images: image_id, filename, split, qa_pairs array<struct<qa_id, question, answer, multiple_choices, type>>. boxes: box_id, x, y, width, height.

    Four different candidates are needed, each with an area; a candidate without a box is an error.
    """
    q = images.where(F.col("split").isin(*SPLITS)).select(
        "image_id", "filename", "split", F.explode("qa_pairs").alias("qa")
    ).select("image_id", "filename", "split", "qa.*").where("qa_id is not null")
    ids = F.concat(F.array("answer"), "multiple_choices").cast("array<string>")
    q = q.withColumn("_ids", ids).where((F.size("_ids") == 4) & (F.size(F.array_distinct("_ids")) == 4))
    q = q.withColumn("_ids", hashed(F.col("_ids"), F.concat(F.lit("visual7w:"), F.col("qa_id").cast("string"))))
    b = boxes.select(
        F.col("box_id").cast("string").alias("_id"),
        F.when((F.col("width") > 0) & (F.col("height") > 0), corners(F.col("x"), F.col("y"), F.col("width"), F.col("height"))).alias("_box"),
        F.lit(True).alias("_known")
    )
    parts = q.select("qa_id", F.posexplode("_ids").alias("_pos", "_id")).join(b, "_id", "left")
    parts = parts.withColumn(
        "_box", F.when(F.col("_known"), F.col("_box")).otherwise(F.raise_error(F.concat(F.lit("no box "), "_id")).cast("array<double>"))
    )
    parts = parts.groupBy("qa_id").agg(F.array_sort(F.collect_list(F.struct("_pos", "_id", "_box"))).alias("_parts"))
    q = q.join(parts, "qa_id").where(~F.exists("_parts", lambda p: p["_box"].isNull()))
    split = F.when(F.col("split") == "val", "dev").otherwise(F.col("split"))
    group = F.concat(F.lit("visual7w-image:"), F.col("image_id").cast("string"))
    return canonical(
        q, sample_id=F.concat(F.lit("visual7w:"), F.col("qa_id").cast("string")), group_id=group, split=split, task_type=text("choice"),
        image=F.concat_ws("/", F.lit(folder), "filename"), question=F.col("question"),
        options=F.transform("_parts", lambda p: option(F.concat(F.lit("box_"), p["_id"]), text("candidate region"), p["_box"])),
        target=F.concat(F.lit("box_"), F.col("answer").cast("string")), evidence_reference=F.concat(F.lit("qa_id:"), F.col("qa_id").cast("string")),
        quality=compact(F.col("type").alias("upstream_question_type")), **facts("visual7w")
    )


def scienceqa(problems: DataFrame, images: str = "images") -> DataFrame:
    """problems: key (the problem id), question, hint, image, split, choices, answer (an index), grade, subject, category. Only problems with a picture."""
    p = problems.where(
        F.col("key").isNotNull() & F.col("image").isNotNull() & F.col("split").isin(*SPLITS) & (F.size("choices") >= 2) & (F.col("answer") >= 0) & (
            F.col("answer") < F.size("choices")
        )
    )
    places = hashed(F.transform("choices", lambda c, i: i.cast("string")), F.concat(F.lit("scienceqa:"), "key"))
    sid = F.concat(F.lit("scienceqa:"), "key")
    return canonical(
        p, sample_id=sid, group_id=sid, split=F.when(F.col("split") == "val", "dev").otherwise(F.col("split")), task_type=text("choice"),
        image=F.concat_ws("/", F.lit(images), F.concat(F.col("split"), F.lit("_images")), "split", "key", "image"),
        state_text=F.coalesce("hint", F.lit("")), question=F.col("question"),
        options=F.transform(places, lambda i: option(F.concat(F.lit("choice_"), i), F.get("choices", i.cast("int")))),
        target=F.concat(F.lit("choice_"), F.col("answer").cast("string")), evidence_reference=F.concat(F.lit("problem_id:"), "key"),
        quality=compact("grade", "subject", "category"), **facts("scienceqa")
    )


def action_text(action: Column, info: Column, points: Column) -> Column:
    """An action as text. points: info as array<array<int>>, where it is one; else info is text."""
    at = lambda i: F.concat(
        F.lit("("), F.get(F.get(points, F.lit(i)), F.lit(0)).cast("string"), F.lit(","), F.get(F.get(points, F.lit(i)), F.lit(1)).cast("string"),
        F.lit(")")
    )
    some = F.coalesce(F.size(points) > 0, F.lit(False))
    plain = F.concat_ws(" ", action, F.coalesce(info, F.lit("None")))
    return (
        F.when(action.isin("COMPLETE", "IMPOSSIBLE"), action)
        .when(action == "TEXT", F.concat(F.lit("TYPE "), F.coalesce(info, F.lit("None"))))
        .when(action.isin("CLICK", "LONG_PRESS") & some, F.concat_ws(" ", action, at(0)))
        .when((action == "SCROLL") & (F.size(points) >= 2), F.concat(F.lit("SCROLL "), at(0), F.lit("->"), at(1)))
        .otherwise(plain)
    )


def gui_odyssey(steps: DataFrame) -> DataFrame:
    """steps: episode_id, step, image, action, info (text, or JSON points), instruction, history array<string> (actions as text), category, device_name.

    One pool of all actions; a step without any other action is left out, as it offers no choice.
    """
    points = F.when(F.col("info").rlike(r"^\s*\["), F.from_json("info", "array<array<int>>"))
    s = steps.where("episode_id is not null and step is not null").withColumn(
        "answer", nest.normalized(action_text(F.upper("action"), F.col("info"), points))
    ).where("answer is not null")
    s = s.withColumn("sample_id", F.concat_ws(":", F.lit("gui-odyssey"), "episode_id", F.col("step").cast("string"))).withColumn("_all", F.lit(0))
    s = cut(one_of_each(s, "sample_id"))
    s = s.join(nest.negatives(s, ["_all"], fallback=False).select("sample_id", "negatives"), "sample_id").where("size(negatives) > 0")
    s = s.withColumn("_values", hashed(F.concat(F.array("answer"), "negatives"), F.col("sample_id")))
    has = lambda c: F.col(c) if c in steps.columns else F.lit(None).cast("string")
    group = F.concat(F.lit("gui-odyssey:"), "episode_id")
    return canonical(
        s, sample_id=F.col("sample_id"), group_id=group, split=text("train"), task_type=text("choice"), image=F.col("image"),
        state_text=F.coalesce("instruction", F.lit("")), allowed_history=F.col("history"),
        options=F.transform("_values", lambda v, i: option(F.concat(F.lit("action_"), i.cast("string")), v)),
        target=F.concat(F.lit("action_"), (F.array_position("_values", F.col("answer")) - 1).cast("string")),
        evidence_reference=F.concat(F.lit("episode:"), "episode_id", F.lit(":step:"), F.col("step").cast("string")),
        quality=compact(has("category").alias("category"), has("device_name").alias("device_name")), **facts("gui_odyssey")
    )


def quintile_cuts(train: DataFrame, value: str = "mos") -> DataFrame:
    """(cuts): the values at a fifth, two, three and four fifths of the rows in order; null values and an empty table give none.

    Values are counted first, then in 4096 ranges between the least and the greatest; only the ranges in which a cut
    falls are ordered.
    """
    c = train.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    ends = c.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("c").alias("n"))
    c = c.join(F.broadcast(ends)).withColumn(
        "bin", F.least(F.lit(4095), F.floor((F.col("v") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * 4096))
    ).na.fill(0, ["bin"])
    bins = c.groupBy("bin").agg(F.sum("c").alias("bc")).withColumn("before", F.sum("bc").over(W.partitionBy(F.lit(0)).orderBy("bin")) - F.col("bc"))
    run = c.join(F.broadcast(bins), "bin").withColumn("upto", F.col("before") + F.sum("c").over(W.partitionBy("bin").orderBy("v")))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.col("n") * q / 5), F.col("v")))
    return run.agg(*[at(q).alias(f"q{q}") for q in range(1, 5)]).select(
        F.filter(F.array("q1", "q2", "q3", "q4"), lambda x: x.isNotNull()).alias("cuts")
    )


def koniq10k(ratings: DataFrame, images: str = "images") -> DataFrame:
    """ratings: image_name, c1 to c5, c_total, mos, sd, mos_zscore. The target is the quintile of the training pictures' mean opinion."""
    r = one_of_each(
        ratings.where("image_name is not null and mos is not null").select(
            "image_name", "mos", "c1", "c2", "c3", "c4", "c5", "c_total", "sd", "mos_zscore"
        ),
        "image_name"
    )
    bucket = byte_mod(F.sha2(F.concat(F.lit("koniq10k:"), "image_name"), 256), 10)
    r = cut(r.withColumn("split", F.when(bucket < 8, "train").when(bucket == 8, "dev").otherwise("test")))
    r = r.join(F.broadcast(quintile_cuts(r.where("split = 'train'"))))
    votes = F.array(*[F.coalesce(f"c{i}", F.lit(0)) for i in range(1, 6)])
    mode = F.array_min(
        F.transform(votes, lambda v, i: F.struct((-v).alias("v"), F.abs(i + 1 - F.col("mos")).alias("d"), (i + 1).alias("level")))
    )["level"]
    stem = F.concat(F.lit("koniq10k:"), F.regexp_replace("image_name", r"\.[^.]*$", ""))
    target = F.concat(F.lit("score_"), (F.size(F.filter("cuts", lambda c: c <= F.col("mos"))) + 1).cast("string"))
    quality = compact(
        votes.alias("rating_counts"), F.col("c_total").alias("rating_total"), "mos", "sd", "mos_zscore", mode.alias("upstream_mode"),
        F.col("cuts").alias("train_mos_quintile_thresholds"), F.lit("dataset_relative_ordinal_human_image_quality_rating").alias("semantics")
    )
    return canonical(
        r, sample_id=stem, group_id=stem, split=F.col("split"), task_type=text("score"), image=F.concat_ws("/", F.lit(images), "image_name"),
        options=F.array(*[option(text(f"score_{i}"), text(f"relative quality level {i}")) for i in range(1, 6)]), target=target,
        evidence_reference=F.concat(F.lit("image_name:"), "image_name"), quality=quality, **facts("koniq10k")
    )


def refcoco(references: DataFrame, images: str = "images") -> DataFrame:
    """references: dataset, split (train or validation), ref_id, ann_id, global_image_id, image_path, bbox, sentences array<struct<sent_id, sent>>.

    A picture that any dev row has is in dev. Its regions, of all rows and datasets, are the candidates, at most 32.
    """
    r = references.where(
        F.col("split").isin("train", "validation") & F.col("ref_id").isNotNull()
    ).withColumn("split", F.when(F.col("split") == "train", "train").otherwise("dev"))
    region = option(
        F.concat(F.lit("region:"), F.col("ann_id").cast("string")), F.concat(F.lit("region region:"), F.col("ann_id").cast("string")), F.col("bbox")
    )
    sound = F.coalesce((F.size("bbox") == 4) & (F.col("bbox")[0] < F.col("bbox")[2]) & (F.col("bbox")[1] < F.col("bbox")[3]), F.lit(False))
    pictures = r.groupBy("global_image_id").agg(F.min("split").alias("split"), F.collect_set(F.when(sound, region)).alias("_regions"))
    target = F.concat(F.lit("region:"), F.col("ann_id").cast("string"))
    j = r.drop("split").join(pictures, "global_image_id").withColumn("_options", last_of_each(F.array_sort("_regions")))
    j = j.where((F.size("_options") >= 2) & F.exists("_options", lambda o: o["id"] == target))
    chosen = capped(F.col("_options"), F.array(target), F.col("ref_id").cast("string"), 32, "\u0000")
    j = j.withColumn("_chosen", F.array_sort(chosen)).select("*", F.explode("sentences").alias("_s"))
    name = F.concat_ws(":", "dataset", F.col("ref_id").cast("string"), F.col("_s.sent_id").cast("string"))
    return canonical(
        j, sample_id=name, root_id=name, group_id=F.col("global_image_id"), source=F.col("dataset"), split=F.col("split"), task_type=text("choice"),
        image=F.concat_ws("/", F.lit(images), F.regexp_extract("image_path", r"([^/]*)$", 1)),
        question=F.concat(F.lit("Which region matches: "), F.col("_s.sent"), F.lit("?")), options=F.col("_chosen"), target=target,
        evidence_reference=F.concat(F.lit("ann_id:"), F.col("ann_id").cast("string")),
        quality=compact(F.lit("oracle").alias("track"), F.lit(True).alias("detector_metrics_must_be_separate")), **facts("refcoco")
    )


def dom_option(raw: Column) -> Column:
    """An option of a page's node given as JSON in JSON; null if it is malformed or has no id or area."""
    node = F.from_json(raw, "tag string, backend_node_id string, attributes string")
    inner = F.from_json(F.coalesce(node["attributes"], F.lit("{}")), "map<string,string>")
    at = lambda k: F.try_element_at(inner, F.lit(k))
    number = F.coalesce(F.when(node["backend_node_id"] != "", node["backend_node_id"]), at("backend_node_id"))
    rect = F.transform(F.split(at("bounding_box_rect"), ","), lambda v: F.trim(v).try_cast("double"))
    shown = F.coalesce(
        *[F.when(at(k) != "", F.trim(at(k))) for k in ("aria_label", "title", "placeholder", "value", "id", "role", "class")], node["tag"],
        F.lit("element")
    )
    fits = (number != "") & (F.size(rect) == 4) & ~F.exists(rect, lambda v: v.isNull()) & (F.get(rect, F.lit(2)) > 0) & (F.get(rect, F.lit(3)) > 0)
    box = corners(*[F.get(rect, F.lit(i)) for i in range(4)])
    return F.when(
        fits,
        option(F.concat(F.lit("dom:"), number), F.substring(F.concat(F.coalesce(node["tag"], F.lit("element")), F.lit(": "), shown), 1, 512), box)
    )


def mind2web(actions: DataFrame, images: str = "images") -> DataFrame:
    """actions: action_uid, operation (JSON), pos_candidates and neg_candidates (arrays of JSON nodes), website, annotation_id, confirmed_task, action_reprs, target_action_index, width, height of the screenshot.

    Repeated actions count once. 31 other candidates are kept by hash, and shown in the order of another.
    """
    kind = F.upper(F.from_json("operation", "op string")["op"])
    a = one_of_each(actions.where("action_uid is not null"), "action_uid").where(
        kind.isin("CLICK", "TYPE", "SELECT") & F.col("target_action_index").try_cast("int").isNotNull()
    )
    nodes = lambda c: last_of_each(F.filter(F.transform(c, dom_option), lambda o: o.isNotNull()))
    a = a.withColumn("_pos", nodes("pos_candidates")).withColumn("_neg", nodes("neg_candidates")).where("size(_pos) > 0 and size(_neg) > 0")
    a = a.withColumn(
        "_target", nest.smallest_of(F.col("_pos"), F.transform("_pos", lambda o: o["id"]))
    ).withColumn("_all", last_of_each(F.concat("_pos", "_neg")))
    uid = F.col("action_uid")
    kept = capped(F.col("_all"), F.array("_target"), uid, 32, "\u0000select\u0000")
    a = a.withColumn("_kept", by_hash(kept, uid, "\u0000order\u0000")).where(
        nest.visible_target(F.col("_kept"), F.col("_target"), F.col("width"), F.col("height"))
    )
    history = F.slice(
        F.coalesce("action_reprs", F.array().cast("array<string>")), F.lit(1), F.greatest(F.lit(0), F.col("target_action_index").cast("int"))
    )
    sid = F.concat(F.lit("mind2web:"), uid)
    return canonical(
        a, sample_id=sid, root_id=sid, group_id=F.concat(F.lit("mind2web-trace:"), "annotation_id"), split=text("train"), task_type=text("choice"),
        image=F.concat_ws("/", F.lit(images), F.concat(uid, F.lit(".jpg"))), state_text=F.col("confirmed_task"), allowed_history=history,
        options=F.col("_kept"), target=F.col("_target"), evidence_reference=F.concat(F.lit("action_uid:"), uid), quality=compact("website"),
        **facts("mind2web")
    )


def redacted(raw: Column) -> Column:
    """An action's type and direction, nothing else, as JSON; null if it is malformed."""
    return F.when(F.get_json_object(raw, "$").isNotNull(), F.to_json(F.from_json(raw, "action_type string, direction string")))


def android_control(steps: DataFrame, splits: DataFrame, images: str = "images") -> DataFrame:
    """steps: episode_id, step, goal, actions (array of JSON, of the whole episode), nodes array<struct<unique_id, visible, clickable, long_clickable, left, top, right, bottom>>, width, height. splits: episode_id, split.

    Records of other splits than train and validation, and of unknown episodes, are left out. Up to 25 nodes, targets
    first, and the seven global actions are the candidates.
    """
    s = steps.where("episode_id is not null and step is not null").join(
        F.broadcast(splits.where(F.col("split").isin("train", "validation")).select("episode_id", F.col("split").alias("_given"))), "episode_id"
    )
    action = F.from_json(F.get("actions", F.col("step")), "action_type string, direction string, x double, y double")
    s = s.withColumn("_a", action).withColumn("_type", F.col("_a.action_type"))
    direct = ("navigate_back", "navigate_home", "wait")
    s = s.where(F.col("_type").isin("click", "long_press", "scroll", *direct))
    usable = F.filter("nodes", lambda n: n["visible"] & (n["right"] > n["left"]) & (n["bottom"] > n["top"]) & (n["clickable"] | n["long_clickable"]))
    node = lambda n: option(
        F.concat(F.lit("node:"), n["unique_id"].cast("string")), text("visible screen element"), F.array(n["left"], n["top"], n["right"], n["bottom"])
    )
    hit = F.filter(usable, lambda n: F.col("_a.x").between(n["left"], n["right"]) & F.col("_a.y").between(n["top"], n["bottom"]))
    moves = [
        option(text(f"global:scroll:{d}"), text(f"scroll {d}")) for d in ("up", "down", "left", "right")
    ] + [option(text(f"global:{k}"), text(k.replace("navigate_", ""))) for k in direct]
    pressed = F.col("_type").isin("click", "long_press")
    targets = F.when(pressed, F.transform(hit, lambda n: F.concat(F.lit("node:"), n["unique_id"].cast("string")))).when(
        F.col("_type") == "scroll", F.array(F.concat(F.lit("global:scroll:"), F.col("_a.direction")))
    ).otherwise(F.array(F.concat(F.lit("global:"), F.col("_type"))))
    s = s.withColumn("_targets", targets).where("size(_targets) > 0 and _targets[0] is not null")
    key = F.concat_ws(":", F.col("episode_id").cast("string"), F.col("step").cast("string"))
    s = s.withColumn("_options", F.concat(capped(last_of_each(F.transform(usable, node)), F.col("_targets"), key, 25, ":"), F.array(*moves)))
    s = s.withColumn("_targets", F.filter("_targets", lambda t: F.exists("_options", lambda o: o["id"] == t))).where("size(_targets) > 0")
    s = s.withColumn("_target", F.when(pressed, nest.smallest_of(F.col("_options"), F.col("_targets"))).otherwise(F.get("_targets", F.lit(0))))
    s = s.where(~pressed | nest.visible_target(F.col("_options"), F.col("_target"), F.col("width"), F.col("height")))
    history = F.filter(F.transform(F.slice("actions", F.lit(1), F.col("step")), redacted), lambda h: h.isNotNull())
    sid = F.concat(F.lit("android-control:"), key)
    return canonical(
        s, sample_id=sid, root_id=sid, group_id=F.concat(F.lit("android-control-episode:"), F.col("episode_id").cast("string")),
        split=F.when(F.col("_given") == "train", "train").otherwise("dev"), task_type=text("choice"),
        image=F.concat(
            F.lit(f"{images}/"), F.col("episode_id").cast("string"), F.lit("-"), F.lpad(F.col("step").cast("string"), 4, "0"), F.lit(".png")
        ),
        state_text=F.col("goal"), allowed_history=history, options=F.col("_options"), target=F.col("_target"),
        evidence_reference=F.concat(F.lit("episode:"), F.col("episode_id").cast("string"), F.lit(":step:"), F.col("step").cast("string")),
        quality=compact(F.col("_given").alias("official_split")), **facts("android_control")
    )


def page_options(raw: Column) -> Column:
    """The options of a page written as ``(uid = …) [[text]] … [[bbox]] x= y= width= height=`` lines, those with an area."""
    number = r"([-\d.]+)"
    bbox = rf"\[\[bbox\]\]\s*x={number}\s+y={number}\s+width={number}\s+height={number}"

    def one(part: Column) -> Column:
        x, y, w, h = (F.regexp_extract(part, bbox, i).try_cast("double") for i in range(1, 5))
        uid = F.regexp_extract(part, r"\(uid = ([^)]+)\)", 1)
        shown = F.substring(F.trim(F.regexp_replace(F.regexp_extract(part, r"\[\[text\]\]\s*(.*?)\s*\[\[bbox\]\]", 1), r"(?U)\s+", " ")), 1, 256)
        return F.when(
            (uid != "") & (w > 0) & (h > 0),
            option(F.concat(F.lit("element:"), uid), F.when(shown != "", shown).otherwise("visible webpage element"), corners(x, y, w, h))
        )

    return F.filter(F.transform(F.split(raw, r"\n(?=\(uid = )"), one), lambda o: o.isNotNull())


def weblinx(turns: DataFrame, selection: DataFrame, images: str = "images") -> DataFrame:
    """turns: demo, turn, utterances, candidates, row (its number in the file). selection: demo, turn, intent, target_uid, screenshot, width, height; null width for a missing picture.

    Turns that aren't selected, have no task, no such target or no picture are left out.
    """
    s = selection.select("demo", "turn", "intent", "target_uid", "screenshot", "width", "height")
    j = turns.select("demo", "turn", "utterances", "candidates", "row").join(s, ["demo", "turn"]).where("width is not null")
    task = F.trim(F.regexp_replace(F.coalesce("utterances", F.lit("")), r"(?U)\s+", " "))
    target = F.concat(F.lit("element:"), "target_uid")
    key = F.concat_ws(":", "demo", F.col("turn").cast("string"))
    j = j.withColumn("_task", task).withColumn("_all", page_options(F.coalesce("candidates", F.lit("")))).where(
        (F.col("_task") != "") & F.exists("_all", lambda o: o["id"] == target)
    )
    j = j.withColumn("_options", capped(F.col("_all"), F.array(target), key, 32, ":")).where(
        nest.visible_target(F.col("_options"), target, F.col("width"), F.col("height"))
    )
    sid = F.concat(F.lit("weblinx:"), key)
    return canonical(
        j, sample_id=sid, root_id=sid, group_id=F.concat(F.lit("weblinx-demo:"), "demo"), split=text("train"), task_type=text("choice"),
        image=F.concat_ws("/", F.lit(images), "demo", F.lit("screenshots"), "screenshot"), state_text=F.col("_task"), options=F.col("_options"),
        target=target, evidence_reference=F.concat(F.lit("demo:"), key, F.lit(":row:"), F.col("row").cast("string")),
        quality=compact("intent", F.lit(False).alias("release_blocked")), **facts("weblinx")
    )



ADAPTERS = {
    f.__name__: f for f in (
        vqav2, textvqa, gqa, clevr, chartqa, mnli, nlvr, visual7w, scienceqa, gui_odyssey, koniq10k, refcoco, mind2web, android_control, weblinx
    )
}
