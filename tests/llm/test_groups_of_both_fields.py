"""Problem 6: classes of look-alikes span sections and answers."""

from textloom.llm import queries


def test_groups_span_both_fields(spark, tmp_path):
    sections = [("s1", "Вạn khám"), ("s2", "Bạn khám"), ("s2", "Bạn khám"), ("s3", "khác"), ("s4", None)]
    answers = [("s1", "Bạn khám"), ("q2", "khác nữa"), ("q3", None)]
    spark.createDataFrame(sections, "section_id string, content string").write.parquet(f"{tmp_path}/article_section.parquet")
    spark.createDataFrame(answers, "qa_identifier string, doctor_answer string").write.parquet(f"{tmp_path}/tamanh_qa.parquet")
    rows = queries.p6_groups(spark, str(tmp_path)).collect()
    assert sorted((r.field, r.key, r.members) for r in rows) == [("content", "s1", 3), ("content", "s2", 3), ("content", "s3", 1), ("doctor_answer", "q2", 1), ("doctor_answer", "s1", 3)]
    assert len({r.skeleton_id for r in rows}) == 3
