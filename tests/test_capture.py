"""Images that are made read back; bad sectors are zeros and told; nothing is overwritten; scans and SMART."""

import hashlib
import json
import os
import random

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tracewell import fixtures
from tracewell.operators import relational as rel
from tracewell.plans import capture, evidence, health
from tracewell.sinks import ewf
from tracewell.sources import blocks, images


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()


@pytest.fixture
def source(tmp_path):
    data = random.Random(3).randbytes(3 << 20) + bytes(2 << 20) + b"text " * 50_000 + b"end"
    with open(f"{tmp_path}/source.bin", "wb") as f:
        f.write(data)
    return f"{tmp_path}/source.bin", data


@pytest.mark.parametrize("compression", ["fast", "none", "best"])
def test_round_trip(spark, source, tmp_path, compression):
    path, data = source
    (r,) = capture.acquire(spark, [{"source": path, "folder": str(tmp_path), "name": "img", "compression": compression, "case": {"case_number": "C-1", "examiner": "H\tS", "model": "Test SSD", "serial": "SN1"}}], hashes=["sha256", "md5", "sha1"], verify=True)
    assert r["error"] is None and list(r["hashes"]) == ["md5", "sha1", "sha256"] and r["hashes"]["sha256"] == hashlib.sha256(data).hexdigest()
    assert r["verify"]["match"] and r["verify"]["hashes"] == r["hashes"] and r["bad_sectors"] == 0
    assert r["paths"] == [f"{tmp_path}/img.E01"] and r["image_bytes"] == os.path.getsize(r["paths"][0])
    image = images.open_image(r["paths"][0])
    assert image.read(0, len(data)) == data and image.size == -(-len(data) // 512) * 512 and image.md5 == r["hashes"]["md5"] and image.sha1 == r["hashes"]["sha1"]
    assert {k: image.fields[k] for k in ("case_number", "examiner", "model", "serial")} == {"case_number": "C-1", "examiner": "H S", "model": "Test SSD", "serial": "SN1"}
    assert all(s.checked for s in image.parts[0]) and [s.kind for s in image.parts[0]][:4] == ["header2", "header2", "header", "volume"]
    assert evidence.damage(evidence.chunks(spark, r["paths"])).count() == 0
    assert (r["image_bytes"] < len(data)) == (True)


def test_segments_and_two_sources(spark, source, tmp_path):
    path, data = source
    other = f"{tmp_path}/other.bin"
    with open(other, "wb") as f:
        f.write(data[:100_001])
    jobs = [{"source": path, "folder": str(tmp_path), "name": "seg", "compression": "none", "segment_size": 1_500_000}, {"source": other, "folder": str(tmp_path), "name": "raw", "format": "dd", "segment_size": 40_000}]
    a, b = capture.acquire(spark, jobs, verify=True)
    assert len(a["paths"]) > 2 and a["paths"][1].endswith(".E02") and a["verify"]["match"] and all(os.path.getsize(p) <= 1_500_000 for p in a["paths"])
    assert [os.path.basename(p) for p in b["paths"]] == ["raw.001", "raw.002", "raw.003"] and b["verify"]["match"]
    assert b"".join(open(p, "rb").read() for p in b["paths"]) == data[:100_001]


def test_bad_sectors_are_zeros_and_told(spark, source, tmp_path):
    path, data = source
    (r,) = capture.acquire(spark, [{"source": path, "folder": str(tmp_path), "name": "bad"}], faults=[5000, 5001, 9000], verify=True)
    assert r["bad_sectors"] == 3 and r["bad_ranges"] == [(5000, 2), (9000, 1)] and r["verify"]["match"]
    want = bytearray(data)
    for lba, n in r["bad_ranges"]:
        want[lba * 512 : (lba + n) * 512] = bytes(512 * n)
    image = images.open_image(r["paths"][0])
    assert image.read(0, len(data)) == bytes(want) and image.errors == 2
    scan = capture.scan(spark, path, "full", faults=[5000, 5001, 9000])
    assert scan["verdict"] == "attention" and scan["bad_ranges"] == [(5000, 2), (9000, 1)]


def test_nothing_is_overwritten_and_failures_leave_no_file(spark, source, tmp_path):
    path, data = source
    keep = f"{tmp_path}/img.dd"
    with open(keep, "wb") as f:
        f.write(b"evidence")
    with pytest.raises(FileExistsError):
        capture.acquire(spark, [{"source": path, "folder": str(tmp_path), "name": "img", "format": "dd"}])
    assert open(keep, "rb").read() == b"evidence"
    with open(f"{tmp_path}/seg.E03", "wb") as f:
        f.write(b"evidence")
    (r,) = capture.acquire(spark, [{"source": path, "folder": str(tmp_path), "name": "seg", "compression": "none", "segment_size": 1_500_000}])
    assert "FileExistsError" in r["error"] and sorted(p for p in os.listdir(tmp_path) if p.startswith("seg")) == ["seg.E03"]
    with pytest.raises(ValueError, match="crc"):
        capture.acquire(spark, [], hashes=["crc"])


def test_a_device_that_is_gone_is_an_error(spark, tmp_path):
    with open(f"{tmp_path}/gone.bin", "wb") as f:
        f.truncate(20 << 20)

    def read(at, n):
        raise OSError("gone")

    patient = blocks.Patient(read)
    with pytest.raises(blocks.Unresponsive):
        # Failures count across blocks.
        for at in range(0, 20 << 20, 1 << 20):
            patient.block(at, 1 << 20)


def test_clear_scans(spark, source):
    path, data = source
    for mode in ("quick", "skip"):
        r = capture.scan(spark, path, mode, smart=fixtures.smart_document())
        assert r["verdict"] == "clear" and r["read_speed"] > 0 and r["findings"][0]["title"] == "SMART healthy"
    r = capture.scan(spark, path, "skip", smart=fixtures.smart_document(failed=True))
    assert r["verdict"] == "attention" and [f["detail"] for f in r["findings"]] == ["SMART overall health self-assessment: FAILED", "Reallocated sectors: 8", "Current pending sectors: 3"]


def test_smart_documents(spark):
    documents = [("ata", json.dumps(fixtures.smart_document())), ("nvme", json.dumps({"nvme_smart_health_information_log": {"media_errors": 2, "critical_warning": 0, "percentage_used": 7}, "model_name": "N"})), ("scsi", json.dumps({"smart_status": {"passed": True}, "scsi_grown_defect_list": 4})), ("none", json.dumps({"smartctl": {"messages": [{"string": "no device"}]}})), ("missing", None)]
    got = {r.device: r for r in health.smart(spark, documents).collect()}
    assert [(a.name, a.value, a.flag) for a in got["nvme"].attributes] == [("Media and data integrity errors", 2, True), ("Critical warning", 0, False), ("Percentage used", 7, False)]
    assert [a.value for a in got["ata"].attributes] == [0, 0, 0, 1200] and got["nvme"].model == "N"
    assert got["none"].reason == "no device" and not got["missing"].available
    verdicts = {r.device: r.verdict for r in health.verdicts(health.findings_of(health.smart(spark, documents)), "device").collect()}
    assert verdicts == {"ata": "clear", "nvme": "attention", "scsi": "attention", "none": "clear", "missing": "clear"}


def test_pack():
    zeros, text, noise = bytes(32768), b"text " * 6000, random.Random(1).randbytes(32768)
    assert ewf.pack(zeros, "none")[1] and ewf.pack(text, "fast")[1] and not ewf.pack(noise, "fast")[1] and not ewf.pack(noise, "best")[1]
    assert ewf.pack(noise, "fast")[0] == noise + ewf.sum_of(noise) and ewf.sample_ratio(noise) > 0.97 > ewf.sample_ratio(text)


@pytest.mark.parametrize("parts", [1, 4, 1000])
def test_islands_across_blocks(spark, parts):
    r = random.Random(parts)
    values = [("a", v) for s in range(0, 300, 20) for v in range(s, s + r.randrange(25))] + [("b", v) for v in range(-9, 60)]
    got = sorted(tuple(x) for x in rel.islands(spark.createDataFrame(values, "k string, v long"), "v", parts, ["k"]).collect())
    want = []
    for k in ("a", "b"):
        for v in sorted({v for x, v in values if x == k}):
            if want and want[-1][0] == k and want[-1][1] + want[-1][2] == v:
                want[-1][2] += 1
            else:
                want.append([k, v, 1])
    assert got == sorted(map(tuple, want))


def test_running_offsets(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("n"))
    got = {r.id: r.start for r in rel.running_offset(df.repartition(5), "n", "id").collect()}
    assert got == {k: sum(x % 7 for x in range(k)) for k in range(1000)}
