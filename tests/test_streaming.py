"""The file-stream scan appends parsed rows to the date-partitioned table."""

from logscope.operators.parse import requests_table
from logscope.sources.logs import load_log_lines
from logscope.sources.sinks import read_requests
from logscope.streaming import append_parsed_logs, parsed_log_stream
from tests.conftest import SF_SMALL


def test_stream_appends_parsed_rows(spark, tmp_path):
    src, out, ckpt = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    lines = load_log_lines(spark, SF_SMALL)
    lines.write.text(src)
    q = append_parsed_logs(parsed_log_stream(spark, src), out, ckpt)
    q.awaitTermination(120)
    got = read_requests(spark, out)
    assert got.count() == lines.count()
    assert "date" in got.columns
    timed = requests_table(lines).where("time IS NOT NULL").count()
    assert 0 < timed == got.where("time IS NOT NULL").count() == got.where("date IS NOT NULL").count() < got.count()


def test_stream_restart_is_exactly_once(spark, tmp_path):
    src, out, ckpt = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    lines = load_log_lines(spark, SF_SMALL).repartition(3)
    lines.write.text(src)
    n = lines.count()
    for _ in range(2):  # the second run resumes from the checkpoint: nothing new
        q = append_parsed_logs(parsed_log_stream(spark, src, max_files_per_trigger=1), out, ckpt)
        q.awaitTermination(120)
    assert read_requests(spark, out).count() == n
    lines.limit(7).write.mode("append").text(src)  # a new file arrives
    q = append_parsed_logs(parsed_log_stream(spark, src, max_files_per_trigger=1), out, ckpt)
    q.awaitTermination(120)
    assert read_requests(spark, out).count() == n + 7
