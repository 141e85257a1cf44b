from chatloom.plans.reference import speaker_filter


def test_names_of_any_length_are_found_among_the_speakers(spark, tmp_path):
    spark.createDataFrame([(1, "Ann, Bo"), (2, "Li"), (3, "Abo"), (4, None), (5, "Nora")], "id bigint, speakers string").write.parquet(f"{tmp_path}/windows.parquet")
    people = [("Bo", "manual"), ("li", "manual"), ("Nora", "manual"), ("A", "manual"), ("An", "auto"), (None, "manual"), ("", "manual")]
    spark.createDataFrame(people, "display_name string, source string").write.parquet(f"{tmp_path}/people.parquet")
    got = sorted(tuple(r) for r in speaker_filter(spark, str(tmp_path)).collect())
    assert got == sorted([(1, "Bo"), (3, "Bo"), (2, "li"), (5, "Nora"), (1, "A"), (3, "A"), (5, "A"), (1, "An"), *((i, "") for i in range(1, 6))])
