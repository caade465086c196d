"""Answer-consistency plans: main question, answer bags, distinct-answer counts.

All topics / (chatbot, group) keys are processed in one job; nothing loops
over groups on the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import question_template
from colloquy.functions.vectors import cosine
from colloquy.operators import clustering as C
from colloquy.operators import topic_fit as TF
from colloquy.operators import topics as TP
from colloquy.operators import vectors as V
from colloquy.operators.joins import join_small
from colloquy.session import stored


def most_frequent(df: DataFrame, group_cols: list[str], value_col: str, out: str = "main") -> DataFrame:
    """Most frequent non-null value per group; ties -> smallest value.

    Counting is keyed by (group, value), so a hot group is spread over all
    tasks; the second step sees one row per distinct value.
    """
    counts = (df.where(F.col(value_col).isNotNull())
              .groupBy(*group_cols, value_col).agg(F.count(F.lit(1)).alias("_n")))
    best = F.min_by(F.struct(F.col(value_col).alias("v"), F.col("_n").alias("n")),
                    F.struct((-F.col("_n")).alias("neg"), F.col(value_col).alias("v")))
    agg = counts.groupBy(*group_cols).agg(best.alias("_b"), F.max("_n").alias("_max"),
                                          F.count(F.lit(1)).alias("_distinct"))
    return agg.select(*group_cols, F.col("_b.v").alias(out), F.col("_b.n").alias("count"),
                      F.col("_distinct").alias("n_distinct"))


def majority(df: DataFrame, group_cols: list[str], value_col: str) -> DataFrame:
    """Majority answer per group, with ``is_tie`` when every answer occurs once
    (the reference then picks at random; here: the smallest answer, flagged)."""
    m = most_frequent(df, group_cols, value_col, "answer")
    return m.withColumn("is_tie", F.col("count") == 1)


def answer_bag(qa: DataFrame, group_cols: list[str], question: str, answer: str, vec_col: str,
               threshold: float, extra: list[str] | None = None) -> DataFrame:
    """Answers to the group's main question plus answers to similar questions.

    Similar = a different question whose vector has cosine > threshold to the
    main question's vector. Duplicates are kept (bag semantics); ``source``
    tells which side a row came from.
    """
    extra = extra or []
    main = most_frequent(qa, group_cols, question, "_main").select(*group_cols, "_main")
    # qa rows (vectors included) are joined to their group's main question once
    # and materialised: they feed both the main-vector lookup and the bag.
    j = join_small(qa, main, on=group_cols).persist()
    mv = (j.where(F.col(question) == F.col("_main"))
          .groupBy(*group_cols).agg(F.first(vec_col).alias("_main_vec")))
    j = join_small(j, mv, on=group_cols)
    j = j.withColumn("similarity", cosine(vec_col, "_main_vec"))
    source = (F.when(F.col(question) == F.col("_main"), F.lit("main"))
              .when(F.col("similarity") > threshold, F.lit("similar")))
    out = j.withColumn("source", source).where(F.col("source").isNotNull())
    return out.select(*group_cols, question, answer, *extra, "source", "similarity")


def with_mean_row(points: DataFrame, group_cols: list[str], id_col: str, vec_col: str) -> DataFrame:
    """Points plus each group's mean vector, flagged ``is_mean``; ``_row`` numbers all rows.

    Stored, so the numbers stay; they stand in for ids, which the mean rows lack. The points are
    stored before, so their vectors are made once for themselves and their means.
    """
    u = V.append_mean_row(stored(points, "points"), group_cols, id_col, vec_col)
    return stored(u.withColumn("_row", F.monotonically_increasing_id()), "points-and-means")


def _sweep(pts: DataFrame, group_cols: list[str], id_col: str) -> DataFrame:
    """Every candidate k of every group, by point: (group..., _row, vec, _labels); seeds are the first own vectors by id."""
    ks = C.k_candidates(pts, group_cols).drop("n")
    firsts = C.first_distinct(pts.where(~F.col("is_mean")), group_cols, id_col, "vec")
    seeds = firsts.join(ks, on=group_cols).where(F.col("rank") < F.col("k")).select(
        *group_cols, "k", F.col("rank").cast("int").alias("cluster"), "center")
    return C.lloyd(pts, seeds, group_cols, "_row", "vec", by_point=True)[0]


def answer_count_per_group(docs: DataFrame, group_cols: list[str], id_col: str, text_col: str,
                           dim: int = 64, reduced: int = 50) -> DataFrame:
    """Number of distinct answers per group by the count rule.

    texts -> hashed vectors -> + group mean row -> random projection ->
    k-means for k = 2..min(10, n-1) -> cosine mean silhouette and Euclidean
    per-point silhouettes -> k with most points above the mean (1 if none).
    """
    emb = V.hash_embed(docs.select(*group_cols, id_col, text_col), text_col, dim, "vec").drop(text_col)
    emb = V.project(emb, "vec", dim, reduced, "vec")  # linear: the mean row may be added before or after
    pts = with_mean_row(emb, group_cols, id_col, "vec")
    j = _sweep(pts, group_cols, id_col)
    keys = [*group_cols, "k"]
    se = C.silhouettes_of_sweep(j, pts, group_cols, "_row", "vec", tile=512)
    mc = C.silhouette(C.silhouette_samples_cosine(j, group_cols, "_row", "vec", labels_col="_labels"), keys)
    cnt = C.count_above_mean(se, mc, keys)
    best = C.best_k_by_count(cnt, group_cols)
    groups = docs.select(*group_cols).distinct()
    return groups.join(best, on=group_cols, how="left").select(
        *group_cols, F.coalesce(F.col("k"), F.lit(1)).alias("k"))


def typical_answers_per_group(bag: DataFrame, group_cols: list[str], id_col: str, answer: str,
                              dim: int = 64, reduced: int = 2,
                              center: str = "median", min_answers: int = 1) -> DataFrame:
    """Typical answers per group (topic): the full consistency plan.

    answers -> hashed vectors -> + mean row -> 2-d projection -> k sweep with
    Euclidean silhouette on the unscaled points -> first maximum -> points
    standardised per group -> k-means with that k (mean row included) ->
    mean row dropped -> per cluster the answer nearest the median/mean.
    Every group gives a result: one with at most ``min_answers`` answers (one
    at least) gives its most frequent answer (the smallest on ties, with its
    smallest id), and one in which no k has a silhouette (such as equal
    answers) is one cluster.
    """
    n = bag.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_n"))
    few = n.where(F.col("_n") <= max(1, min_answers)).select(*group_cols)
    answered = bag.join(few, on=group_cols, how="left_semi").groupBy(*group_cols, answer).agg(
        F.count(F.lit(1)).alias("_c"), F.min(id_col).alias("_id"))
    first = F.min_by(F.struct("_id", answer), F.struct((-F.col("_c")).alias("neg"), F.col(answer)))
    short = answered.groupBy(*group_cols).agg(first.alias("_f")).select(
        *group_cols, F.lit(0).alias("cluster"), F.col("_f._id").alias(f"medoid_{id_col}"), F.col(f"_f.{answer}").alias(answer))
    bag = bag.join(few, on=group_cols, how="left_anti")
    emb = V.hash_embed(bag.select(*group_cols, id_col, answer), answer, dim, "vec")
    emb = V.project(emb.drop(answer), "vec", dim, reduced, "vec")
    pts = with_mean_row(emb, group_cols, id_col, "vec")
    keys = [*group_cols, "k"]
    samples = C.silhouettes_of_sweep(_sweep(pts, group_cols, id_col), pts, group_cols, "_row", "vec", tile=512)
    best = C.best_k_first_max(C.silhouette(samples, keys), group_cols).select(*group_cols, "k").persist()
    scaled = V.standardize(pts, group_cols, "vec", "vec").join(best, on=group_cols).checkpoint(eager=True)
    firsts = C.first_distinct(scaled.where(~F.col("is_mean")), group_cols, id_col, "vec")
    seeds = firsts.join(best, on=group_cols).where(F.col("rank") < F.col("k")).select(
        *group_cols, "k", F.col("rank").cast("int").alias("cluster"), "center")
    assigned, _ = C.lloyd(scaled, seeds, group_cols, "_row", "vec")
    final = assigned.select("_row", "cluster").join(scaled.drop("k"), on="_row")
    typ = C.typical_members(final, group_cols, id_col, "vec", "cluster", center, flag_col="is_mean")
    alone = pts.where(~F.col("is_mean")).join(best, on=group_cols, how="left_anti")
    whole = V.medoid(alone, group_cols, id_col, "vec", center).withColumn("cluster", F.lit(0))
    typ = typ.select(*group_cols, "cluster", f"medoid_{id_col}").unionByName(
        whole.select(*group_cols, "cluster", f"medoid_{id_col}"))
    answers = bag.select(*group_cols, F.col(id_col).alias(f"medoid_{id_col}"), answer)
    out = typ.join(answers, on=[*group_cols, f"medoid_{id_col}"], how="inner")
    return out.select(*group_cols, "cluster", f"medoid_{id_col}", answer).unionByName(short)


def topics_matching_words(qa: DataFrame, words: DataFrame, kinds: list[str], topic: str, question: str, vec_col: str,
                          id_col: str, dim: int = 64, top_n: int = 10, n_representative: int = 3, bar: float = 0.65) -> DataFrame:
    """(word, kind, topic): topics found for a subject word that hold a question like the word's template.

    A word's topics are the ``top_n`` of largest cosine between its vector and the topic's mean question
    vector; a topic matches a kind of question (``like``, ``favorite``, ``no-fill``) if one of its ``n_representative``
    questions nearest to the mean has a cosine of ``bar`` or more to the template filled with the word.
    """
    topic_vecs = stored(TP.topic_vectors(qa, topic, vec_col), "topic-vectors")
    subjects = V.hash_embed(words.select("word").distinct(), "word", dim, "query_vec")
    found = TF.topics_of_texts(topic_vecs, subjects, topic, "word", n=top_n).select("word", topic)
    asked = reduce(DataFrame.unionByName, [words.select("word").distinct().select(
        "word", F.lit(k).alias("kind"), question_template(k, F.col("word")).alias("_asked")) for k in kinds])
    asked = V.hash_embed(asked, "_asked", dim, "_asked_vec").select("word", "kind", "_asked_vec")
    reps = TP.representatives(qa, topic_vecs, topic, id_col, vec_col, n_representative).select(topic, F.col(vec_col).alias("_rep"))
    pairs = found.join(asked, "word").join(reps, topic)
    return pairs.where(cosine("_rep", "_asked_vec") >= bar).select("word", "kind", topic).distinct()


def likes_by_word(qa: DataFrame, words: DataFrame, kinds: list[str], topic: str, question: str, answer: str, vec_col: str,
                  score_col: str, id_col: str, threshold: float = 0.95, zs_threshold: float = 0.7, bar: float = 0.65,
                  dim: int = 64, min_answers: int = 1) -> DataFrame:
    """(word, kind, topic, cluster, medoid id, answer): from subject words to the typical answers of their topics.

    Word -> topics -> those with a representative question like the template -> their questions whose topic
    score exceeds ``zs_threshold`` -> main question and near copies -> answers -> typical answers. Every topic that some
    word matches is worked out once. Each topic filters the original rows, not what an earlier topic left over.
    """
    matched = stored(topics_matching_words(qa, words, kinds, topic, question, vec_col, id_col, dim, bar=bar), "matched-topics")
    rows = qa.where(F.col(score_col) > zs_threshold).join(matched.select(topic).distinct(), topic, "left_semi")
    bag = stored(answer_bag(rows, [topic], question, answer, vec_col, threshold, extra=[id_col]), "answers")
    typical = typical_answers_per_group(bag, [topic], id_col, answer, dim, min_answers=min_answers)
    return matched.join(typical, topic).select("word", "kind", topic, "cluster", f"medoid_{id_col}", answer)
