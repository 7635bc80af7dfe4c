import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from hostwatch.config import ZEEK_REQUIRED
from hostwatch.operators import sessions as SS
from hostwatch.plans import datasets as PD, ingest
from hostwatch.sources import datasets as DS, delimited, tables as T, zeek

FIELDS = [*ZEEK_REQUIRED, "uid"]


def conn(ts, src="10.0.0.1", dst="8.8.8.8", dur="1.5", ob="100", rb="50", op="3", rp="2", uid="C1", history="ShADad"):
    return dict(zip(FIELDS, [str(ts), src, dst, "5000", "443", "tcp", dur, ob, rb, op, rp, "SF", history, uid]))


def write_log(path, entries, order=FIELDS, header=True):
    path.parent.mkdir(parents=True, exist_ok=True)
    head = ["#separator \\x09", "#path\tconn"] + (["#fields\t" + "\t".join(order)] if header else [])
    path.write_text("\n".join(head + ["\t".join(e[f] for f in order) for e in entries] + ["#close\t2024"]) + "\n")
    return str(path)


ENTRIES = [conn(100.5), conn(160.25, ob="-", dur="-"), conn(130, history="a#b", uid="C3"), conn(190, op="0", rp="0"), conn(200, dur="-4")]


def test_zeek_scan_and_features(spark, tmp_path):
    path = write_log(tmp_path / "a" / "conn.log", ENTRIES)
    raw = zeek.read_zeek(spark, [path]).rows
    assert raw.count() == 5 and raw.filter("history = 'a#b'").count() == 1 and raw.filter("orig_bytes IS NULL").count() == 1
    got = ingest.zeek_to_flows(spark, [path]).orderBy("ts").collect()
    assert [r.ts for r in got] == [100.5, 130.0, 160.25, 200.0]
    assert [r.iat for r in got] == [0.0, 29.5, 30.25, 39.75]
    assert [r.duration for r in got] == [1.5, 1.5, 0.0, 0.0] and [r.orig_bytes for r in got] == [100.0, 100.0, 0.0, 100.0]
    assert got[0].is_outbound == 1.0 and got[0].src_port == 5000.0 and got[0].bytes_per_pkt == pytest.approx(30.0)


def test_column_order_per_file(spark, tmp_path):
    one = write_log(tmp_path / "one" / "conn.log", ENTRIES[:2])
    two = write_log(tmp_path / "two" / "conn.log", ENTRIES[2:3], order=FIELDS[::-1])
    rows = zeek.read_zeek(spark, [one, two]).rows
    assert {r["ts"]: r["id.orig_h"] for r in rows.collect()} == {"100.5": "10.0.0.1", "160.25": "10.0.0.1", "130": "10.0.0.1"}


def test_bad_files(spark, tmp_path):
    good = write_log(tmp_path / "g" / "conn.log", ENTRIES)
    bare = write_log(tmp_path / "b" / "conn.log", ENTRIES, header=False)
    short = write_log(tmp_path / "s" / "conn.log", ENTRIES, order=FIELDS[:5])
    with pytest.raises(ValueError, match="#fields"):
        zeek.read_zeek(spark, [bare])
    with pytest.raises(ValueError, match="missing required"):
        zeek.read_zeek(spark, [short])
    found = zeek.read_zeek(spark, [good, bare, short], on_error="quarantine")
    assert found.rows.count() == 5 and found.rejected.count() == 2


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    write_log(root / "TA0011" / "T1071" / "conn.log", [conn(i * 10, src="10.0.0.9") for i in range(4)])
    write_log(root / "benign" / "conn.log", [conn(i * 10) for i in range(5)])
    write_log(root / "misc" / "conn.log", [conn(i * 10 + 5, dst="9.9.9.9") for i in range(3)])
    write_log(root / "misc2" / "conn.log", [conn(1)], header=False)
    write_log(root / "benign" / "ssl.log", [{"ts": "1", "uid": "C1", "version": "TLSv12"}], order=["ts", "uid", "version"])
    return str(root)


def test_labelled_tree(spark, tree):
    flows, rejected = ingest.labelled_tree_to_flows(spark, tree)
    got = {(r.capture_id, r.label): r["count"] for r in flows.groupBy("capture_id", "label").count().collect()}
    assert got == {("TA0011/T1071", 1): 4, ("benign", 0): 5, ("misc", 0): 3}
    assert rejected.count() == 1 and "misc2" in rejected.first().path
    sessions = ingest.labelled_tree_to_sessions(spark, tree)
    assert sorted((r.label, r.all_flows) for r in sessions.collect()) == [(0, 3), (0, 5), (1, 4)]
    assert len(zeek.labelled_files(spark, tree)) == 4
    assert zeek.read_aux_logs(spark, tree, "ssl").first().version == "TLSv12" and zeek.read_aux_logs(spark, tree, "dns") is None
    with pytest.raises(FileNotFoundError):
        zeek.labelled_files(spark, tree + "/none")
    with pytest.raises(ValueError):
        ingest.labelled_tree_to_sessions(spark, tree, min_flows=50)


BINETFLOW = """StartTime,Dur,Proto,SrcAddr,Sport,DstAddr,Dport,TotPkts,TotBytes,SrcBytes,Label
2011/08/10 09:46:53.047277,3.5,tcp,147.32.84.165,0x1F90,8.8.8.8,80,7,1000,400,flow=From-Botnet-V42
2011/08/10 09:47:53.9,1.0,tcp,147.32.84.165,1025,8.8.8.8,80,4,100,400,flow=From-Botnet-V42
bad time,1.0,tcp,147.32.84.165,1025,8.8.8.8,80,4,100,400,flow=Background
2011/08/10 09:46:53.0,1.0,udp,10.0.0.1,53,8.8.4.4,53,2,200,100,flow=Background
"""


def test_binetflow(spark, tmp_path):
    path = tmp_path / "x.binetflow"
    path.write_text(BINETFLOW)
    got = ingest.binetflow_to_flows(spark, [str(path)]).orderBy("proto", "ts").collect()
    assert [(r.ts, r.label, r.src_port, r.orig_pkts, r.resp_pkts, r.resp_bytes, r.iat) for r in got] == [
        (1312969613.0, 1, 8080.0, 4.0, 3.0, 600.0, 0.0), (1312969673.0, 1, 1025.0, 2.0, 2.0, 0.0, 60.0),
        (1312969613.0, 0, 53.0, 1.0, 1.0, 100.0, 0.0)]
    sessions = ingest.binetflow_to_sessions(spark, [str(path)])
    assert sorted((r.label, r.all_flows) for r in sessions.collect()) == [(0, 1), (1, 2)]


GENERIC = "start_time;SrcAddr;DstAddr;Proto;Dur;TotBytes;SrcBytes;TotPkts\n" + "".join(
    f"2024-01-01 00:00:{i:02d};10.0.0.1;1.2.3.4;TCP;1;100;40;5\n" for i in range(6))


def test_mixed_inputs(spark, tmp_path):
    generic, log = tmp_path / "flows.csv", write_log(tmp_path / "z" / "conn.log", [conn(i) for i in range(5)])
    generic.write_text(GENERIC)
    odd = tmp_path / "odd_conn.csv"
    odd.write_text(GENERIC.replace(";", "\t"))
    assert delimited.read_flows(spark, str(generic))[1] == "delimited" and delimited.read_flows(spark, log)[1] == "zeek"
    assert delimited.read_flows(spark, str(odd))[1] == "delimited"
    std, _ = delimited.read_standard_flows(spark, str(generic))
    r = std.orderBy("ts").first()
    assert (r.ts, r.proto, r.resp_bytes, r.orig_pkts, r.resp_pkts) == (1704067200.0, "tcp", 60.0, 3.0, 2.0)
    got = ingest.mixed_to_sessions(spark, [str(generic), str(odd)], [log])
    assert sorted((r.capture_id, r.label, r.all_flows) for r in got.collect()) == [("conn.log", 0, 5), ("flows.csv", 1, 6), ("odd_conn.csv", 1, 6)]
    with pytest.raises(ValueError):
        ingest.mixed_to_sessions(spark)


def test_source_specs():
    assert DS.parse_source_spec("data/x.npz:ctu13:c2") == DS.SourceSpec("data/x.npz", "ctu13", "c2")
    assert DS.parse_source_spec("D:\\data\\x.npz:UWF_ZeekData24:Mixed") == DS.SourceSpec("D:\\data\\x.npz", "uwf_zeekdata24", "mixed")
    assert DS.parse_source_spec("a:b:other:benign").source == "unknown"
    for bad in ("x", "a:b", "a:ctu13:nope"):
        with pytest.raises(ValueError):
            DS.parse_source_spec(bad)


@pytest.fixture(scope="module")
def sessions(spark):
    return SS.build_sessions(T.flows_from_events(spark, SMALL), timeout=T.EVENT_TIMEOUT).cache()


def test_session_dataset_contract(spark, tmp_path, sessions):
    path = str(tmp_path / "s")
    DS.write_sessions(sessions, path)
    assert DS.read_sessions(spark, path).count() == sessions.count()
    alias = str(tmp_path / "alias")
    sessions.withColumnsRenamed({"flows": "X", "label": "y"}).write.parquet(alias)
    assert {"flows", "label"} <= set(DS.read_sessions(spark, alias).columns)
    other = str(tmp_path / "other")
    sessions.withColumn("flows", F.transform("flows", lambda x: F.struct(x["iat"].alias("iat")))).write.parquet(other)
    with pytest.raises(ValueError, match="feature layout"):
        DS.read_sessions(spark, other)
    with pytest.raises(ValueError, match="needs a column"):
        sessions.drop("flows").write.parquet(str(tmp_path / "none"))
        DS.read_sessions(spark, str(tmp_path / "none"))
    long = str(tmp_path / "long")
    sessions.limit(3).withColumn("flows", F.flatten(F.array_repeat(F.col("flows"), 21))).write.parquet(long)
    with pytest.raises(Exception, match="longer than"):
        DS.read_sessions(spark, long).agg(F.sum(F.size("flows"))).collect()


def test_dataset_builds(spark, tmp_path, sessions):
    c2, benign = str(tmp_path / "sliver_run"), str(tmp_path / "quiet")
    DS.write_sessions(sessions.filter("dst_ip = '8.8.8.8'").limit(40), c2)
    DS.write_sessions(sessions.filter("dst_ip <> '8.8.8.8'"), benign)
    built = PD.build_dataset(spark, c2, benign, str(tmp_path / "v1"), c2_ratio=0.4)
    assert built.filter("label = 1").count() == 40 and built.count() == 100 and built.filter("split = 'val'").count() == 15

    havoc = str(tmp_path / "havoc_run")
    DS.write_sessions(sessions.filter("dst_ip = '192.168.7.9'").limit(30), havoc)
    specs = [f"{c2}:ctu13:c2", f"{havoc}:custom_lab:c2", f"{benign}:uwf_zeekdata24:benign"]
    out = PD.build_dataset_v2(spark, specs, str(tmp_path / "v2"))
    stored = spark.read.parquet(out["sessions"])
    fams = {(r.split, r.c2_family) for r in stored.filter("label = 1").select("split", "c2_family").distinct().collect()}
    assert {f for s, f in fams if s == "test"} & {f for s, f in fams if s == "train"} == set()
    assert {f for _, f in fams} == {"sliver", "havoc"} and stored.select("source").distinct().count() == 3
    meta = spark.read.json(out["metadata"]).first()
    assert meta.total_samples == stored.count() and len(meta.host_stats) == 3 and meta.family_overlap_train_test == []
    tl = DS.read_timelines(spark, out["timelines"], keys=("split", "host_id"))
    assert tl.host_sessions.count() == stored.count()
    assert tl.host_profile.filter("split = 'train'").count() == stored.filter("split = 'train'").select("host_id").distinct().count()


def test_argus_files_of_different_column_order(spark, tmp_path):
    (tmp_path / "a.binetflow").write_text("StartTime,SrcAddr,DstAddr,Label\n2011/08/10 09:46:53,10.0.0.1,8.8.8.8,x\n")
    (tmp_path / "b.binetflow").write_text("StartTime,DstAddr,SrcAddr,Label\n2011/08/10 09:46:54,8.8.4.4,10.0.0.2,y\n")
    got = delimited.read_binetflow(spark, [str(tmp_path / n) for n in ("a.binetflow", "b.binetflow")]).select("SrcAddr", "DstAddr", "Label")
    assert sorted(map(tuple, got.collect())) == [("10.0.0.1", "8.8.8.8", "x"), ("10.0.0.2", "8.8.4.4", "y")]


def test_folders_globs_and_few_branches(spark, tmp_path):
    for n in range(30):
        folder = tmp_path / f"d{n % 3}"
        folder.mkdir(exist_ok=True)
        (folder / f"f{n}.csv").write_text(("a,b\n" if n % 2 else "b,a\n") + f"{n},{n}\n")
    assert delimited.read_delimited(spark, [str(tmp_path)]).count() == 30 == delimited.read_delimited(spark, [str(tmp_path / "d*/f*.csv")]).count()
    assert len(delimited.read_flow_files(spark, [str(tmp_path / "d0"), str(tmp_path / "d[12]")])) == 2
    with pytest.raises(FileNotFoundError):
        delimited.read_delimited(spark, [str(tmp_path / "none*")])


def test_a_truncated_file_is_set_aside(spark, tmp_path):
    """A cut-off archive among good files: the rows of the good ones, none of its own, and one rejected path; also one cut inside its head."""
    import gzip

    paths = []
    for n in range(12):
        plain = write_log(tmp_path / f"d{n}" / "conn.log", [conn(100 * n + k, uid=f"C{n}-{k}") for k in range(400)])
        data = gzip.compress(open(plain, "rb").read())
        path = tmp_path / f"d{n}" / "conn.log.gz"
        path.write_bytes(data[:len(data) // 2] if n == 5 else data[:12] if n == 8 else data)
        paths.append(f"file:{path}")
    found = zeek.read_zeek(spark, paths, on_error="quarantine")
    assert found.rows.count() == 10 * 400 and found.rows.filter("uid LIKE 'C5-%' OR uid LIKE 'C8-%'").count() == 0
    rejected = {r.path: r.error for r in found.rejected.collect()}
    assert sorted(p.split("/")[-2] for p in rejected) == ["d5", "d8"]
    with pytest.raises(Exception):
        zeek.read_zeek(spark, paths).rows.count()
    assert zeek.broken_bodies(spark, [p for p in paths if "/d5/" not in p and "/d8/" not in p]) == {}
