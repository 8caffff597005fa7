"""Sinks, readers and streams: round trips, failures and repeated batches."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from cardfile.sources import store
from cardfile.sources import tables as sources
from cardfile.streaming import streams


def test_a_failing_write_leaves_the_old_folder(spark, tmp_path):
    path = f"file://{tmp_path}/list"
    store.replace_folder(spark.range(5), path)
    store.replace_folder(spark.read.parquet(path).where("id > 1"), path)  # it may read what it replaces
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [2, 3, 4]
    broken = spark.range(9).select(F.when(F.col("id") == 8, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="no"):
        store.replace_folder(broken, path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [2, 3, 4] and os.listdir(tmp_path) == ["list"]


def test_a_failing_rename_gives_the_old_folder_back(spark, tmp_path, monkeypatch):
    path, moves = f"file://{tmp_path}/list", store.move
    store.replace_folder(spark.range(3), path)
    monkeypatch.setattr(store, "move", lambda s, old, new: (_ for _ in ()).throw(OSError("no")) if ".new-" in old else moves(s, old, new))
    with pytest.raises(OSError):
        store.replace_folder(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3 and os.listdir(tmp_path) == ["list"]


def test_readers(spark, tmp_path):
    at = f"file://{tmp_path}"
    (tmp_path / "geo.json").write_text('{"type":"node","id":5,"lat":1.5,"lon":2.5,"tags":{"name":"X"}}\n')
    assert sources.read_geo_elements(spark, f"{at}/geo.json").first().asDict() == {"type": "node", "id": 5, "lat": 1.5, "lon": 2.5, "tags": {"name": "X"}}
    (tmp_path / "places.json").write_text('{"id":"p","title":" T ","contacts":[{"www":[{"value":"ftp://x"},{"value":"http://t.test"}],"phone":[{"value":"1"}]}]}\n{"id":"q","title":"no site"}\n')
    assert [tuple(r) for r in sources.read_place_results(spark, f"{at}/places.json").collect()] == [("p", "T", "http://t.test", "1")]
    spark.createDataFrame([(1, "u", "<p>", "extra")], "page_id long, url string, html string, more string").write.parquet(f"{at}/pages")
    assert sources.read_pages(spark, f"{at}/pages").columns == ["page_id", "url", "html"]
    spark.createDataFrame([("d.test", 15, 0, 15, "10 mx.")], sources.DNS_ANSWER).write.parquet(f"{at}/dns")
    assert sources.read_dns_answers(spark, f"{at}/dns").count() == 1
    cities = sources.parse_city_list(spark.createDataFrame([("Austin, Texas; ;Boston",)], "c string"), "c").collect()
    assert [r.city for r in cities] == ["Austin, Texas", "Boston"]
    sources.write_report(spark.createDataFrame([("a@b.test", "A", "valid", "ok")], "email string, company string, status string, reason string"), f"{at}/report")
    assert spark.read.option("header", True).csv(f"{at}/report").first().asDict() == {"Email": "a@b.test", "Company": "A", "Status": "valid", "Reason": "ok"}


def test_a_log_has_each_batch_once(spark, tmp_path):
    at = f"file://{tmp_path}"
    rows = spark.createDataFrame([("A@b.test",), ("c@d.test",)], "recipient_email string")
    sources.append_processed_log(rows, f"{at}/plain")
    sources.append_processed_log(rows, f"{at}/plain")
    assert spark.read.parquet(f"{at}/plain").count() == 4 and {r.email for r in sources.processed_emails(spark.read.parquet(f"{at}/plain")).collect()} == {"a@b.test", "c@d.test"}
    rows.write.parquet(f"{at}/in")
    stream = lambda: streams.contact_stream(spark, f"{at}/in", "recipient_email string", files_per_trigger=1)
    streams.log_stream(stream(), f"{at}/log", f"{at}/state").awaitTermination()
    whole = spark.read.parquet(f"{at}/log").count()
    last = max(glob.glob(f"{tmp_path}/state/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    os.remove(last)  # as if the driver had died between writing and committing
    for crc in glob.glob(f"{tmp_path}/state/commits/.*crc"):
        os.remove(crc)
    streams.log_stream(stream(), f"{at}/log", f"{at}/state").awaitTermination()
    assert whole == spark.read.parquet(f"{at}/log").count() == 2


def test_layouts_arrive_in_two_triggers(spark, tmp_path):
    at, folder = f"file://{tmp_path}", tmp_path / "in"
    folder.mkdir()
    run = lambda: streams.contact_file_stream(spark, f"{at}/in", f"{at}/out", f"{at}/state").awaitTermination()
    (folder / "a.csv").write_text('﻿Company Name,Website,Contact Email,All Emails Found\r\n"Acme, Inc",https://a.test,x1@a.test,"x1@a.test; y@a.test"\r\n', encoding="utf-8", newline="")
    (folder / "sent_log.csv").write_text("name,website,emails\nNo,no.test,no@no.test\n")
    run()
    (folder / "old.csv").write_text("name,website,emails\nOld,old.test,old@old.test\n")
    (folder / "b.csv").write_text("Company Name,WhatsApp Link,Website,Contact Email,All Emails Found\nBee,wa,https://b.test,,bee@b.test\nJunk,,,,noreply@j.test\n")
    (folder / "other.csv").write_text("a,b\n1,2\n")
    run()
    run()
    found = sorted((r.file, r.company_name, r.all_emails_found) for r in spark.read.parquet(f"{at}/out").collect())
    assert found == [("a.csv", "Acme, Inc", "x1@a.test; y@a.test"), ("b.csv", "Bee", "bee@b.test"), ("old.csv", "Old", "old@old.test")]
    from cardfile.operators.clean import clean_contacts

    whole = clean_contacts(sources.to_contact_schema(sources.read_contacts(spark, f"{at}/in")))
    assert sorted((r.file, r.company_name, r.all_emails_found) for r in whole.collect()) == found


def test_addresses_return_after_the_delay(spark, tmp_path):
    at = f"file://{tmp_path}"
    batches = [
        [("A@x.test ", "2024-01-01 10:00:00"), ("a@x.test", "2024-01-01 12:00:00"), ("b@x.test", "2024-01-01 11:00:00"), ("", "2024-01-01 11:00:00"), (None, None)],
        [("a@x.test", "2024-01-02 09:59:59"), ("b@x.test", "2024-01-02 11:00:00"), ("c@x.test", "2024-01-03 00:00:00")],
        [("a@x.test", "2024-01-02 10:00:00"), ("d@x.test", "2024-01-01 23:59:59"), ("c@x.test", "2024-01-03 23:00:00"), ("c@x.test", "2024-01-04 00:00:00")],
    ]
    for rows in batches:
        spark.createDataFrame(rows, "email string, ts string").select("email", F.col("ts").cast("timestamp").alias("ts")).write.mode("append").parquet(f"{at}/in")
        stream = streams.contact_stream(spark, f"{at}/in", "email string, ts timestamp")
        streams.suppress_with_expiry_stream(stream, f"{at}/out", f"{at}/state").awaitTermination()
    shown = lambda kind: sorted((r.email_key, r.at) for r in spark.read.parquet(f"{at}/out/{kind}").select("email_key", F.date_format("at", "dd HH:mm:ss").alias("at")).collect())
    assert shown("kept") == [("a@x.test", "01 10:00:00"), ("a@x.test", "02 10:00:00"), ("b@x.test", "01 11:00:00"), ("b@x.test", "02 11:00:00"), ("c@x.test", "03 00:00:00"), ("c@x.test", "04 00:00:00")]
    assert shown("late") == [("d@x.test", "01 23:59:59")]
