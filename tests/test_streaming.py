from matchframe.streaming.feeds import append_new_results, results_stream

HEAD = "Date,HomeTeam,AwayTeam,FTHG,FTAG,FTR,HS,AS,HST,AST\n"


def test_each_match_is_appended_once(spark, tmp_path):
    inbox, table, progress = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "progress")
    inbox.mkdir()
    (inbox / "a.csv").write_text(HEAD + "21/08/2020,A,B,1,0,H,9,8,4,3\n22/08/2020,C,D,1,1,D,9,8,4,3\n")

    def run():
        append_new_results(results_stream(spark, str(inbox), "2021"), table, progress).awaitTermination()
        return sorted((str(r.match_date), r.home, r.result) for r in spark.read.parquet(table).collect())

    assert run() == [("2020-08-21", "A", "H"), ("2020-08-22", "C", "D")]
    (inbox / "b.csv").write_text(HEAD + "22/08/2020,C,D,1,1,D,9,8,4,3\n23/08/2020,E,F,0,2,A,9,8,4,3\n")
    assert run() == [("2020-08-21", "A", "H"), ("2020-08-22", "C", "D"), ("2020-08-23", "E", "A")]
    assert len(run()) == 3
