"""Several contests in one read: frames, clocks and player ids repeat from one to the next."""

import json

from pacelane.operators import joins
from pacelane.operators import structure as st
from pacelane.sources import readers

CONTEST = "/match=([^/]+)/"
CLOCK = "contest_id string, frame_idx bigint, period_number int, wall_clock_ms bigint, canonical_time_ns bigint, game_clock_s double, shot_clock_s double"
EVENT = "contest_id string, event_no bigint, family string, period_number int, source_frame_idx bigint, wall_clock_ms bigint, game_clock_s double, shot_clock_s double"


def test_links_stay_inside_their_contest(spark):
    clock = [(c, f, 1, 1000 + f, f * 10, 60.0 - f, None) for c in ("a", "b") for f in (10, 11)]
    events = [("a", 1, "shots", 1, 10, None, None, None), ("b", 2, "shots", 1, None, 1011, None, None), ("b", 3, "shots", 1, None, None, 50.0, None), (None, 4, "shots", 1, 10, None, None, None)]
    linked = joins.link_events_to_frames(spark.createDataFrame(events, EVENT), spark.createDataFrame(clock, CLOCK), keys=["contest_id"])
    got = {r.event_no: (r.contest_id, r.link_method, r.linked_frame_idx) for r in linked.collect()}
    assert linked.count() == 4
    assert got == {1: ("a", "frameIdx", 10), 2: ("b", "wallClock", 11), 3: ("b", "gameClock", 10), 4: (None, None, None)}


def test_coincidence_and_frames_by_contest(spark):
    pose = spark.createDataFrame([(c, 5, 1, "t", "p1", 0.0, 0.0) for c in "ab"], "contest_id string, frame bigint, period int, timestamp string, player_id string, x double, y double")
    tracking = spark.createDataFrame([(c, 2, 1, "t", "p1", x, 0.0) for c, x in (("a", 3.0), ("b", 4.0))], pose.schema)
    assert sorted((r.contest_id, r.residual_m) for r in joins.coincidence(pose, tracking, keys=["contest_id"]).collect()) == [("a", 3.0), ("b", 4.0)]
    from pyspark.sql import functions as F

    clock = spark.createDataFrame([("a", 0), ("b", 0)], "contest_id string, canonical_time_ns bigint")
    spots = spark.createDataFrame([(c, 0, "p1", "player", "home", x, 0.0) for c, x in (("a", 1.0), ("b", 2.0))], "contest_id string, t_rel_ns bigint, object_id string, object_type string, group_id string, x_m double, y_m double")
    roster = spark.createDataFrame([("a", "p1", "Ann"), ("b", "p1", "Bea")], "contest_id string, object_id string, display_name string")
    found = joins.frames_with_players(clock, spots, roster, F.lit(1.0), keys=["contest_id"]).collect()
    assert sorted((r.contest_id, [(p.display_name, p.x) for p in r.players]) for r in found) == [("a", [("Ann", 1.0)]), ("b", [("Bea", 2.0)])]


def write(folder, name, lines):
    (folder / name).mkdir(parents=True)
    (folder / name / "part.jsonl").write_text("\n".join(lines))


def test_tracking_of_two_matches_in_one_folder(spark, tmp_path):
    line = lambda k: json.dumps({"line": k, "frame": k, "timestamp": f"00:00:0{k}.00", "period": 1, "player_data": [{"player_id": "7", "x": 1.0, "y": 2.0, "is_detected": True}]})
    for match in ("m1", "m2"):
        write(tmp_path, f"match={match}", [line(k) for k in range(3)])
    write(tmp_path, "loose", [line(0)])
    roster = spark.createDataFrame([("m1", "7", "home", False), ("m2", "7", "away", True)], "contest_id string, object_id string, group_id string, is_goalkeeper boolean")
    rows = readers.read_tracking_jsonl(spark, str(tmp_path), roster, contest=CONTEST).collect()
    got = sorted((r.contest_id or "", r.frame, r.group_id, r.object_type, r.rule) for r in rows)
    assert got == [("", 0, None, "player", "unknown_participant")] + [("m1", k, "home", "player", None) for k in range(3)] + [("m2", k, "away", "goalkeeper", None) for k in range(3)]


def test_position_sheets_have_an_origin_each(spark, tmp_path):
    for match, hour in (("m1", 10), ("m2", 15)):
        (tmp_path / f"match={match}").mkdir()
        body = ["sheet,row_no,local_time,latitude,longitude,speed_kmh"] + [f"s,{k},2024-01-01 {hour}:00:0{k}.000,43.0,-5.0,3.6" for k in range(2)]
        (tmp_path / f"match={match}" / "a.csv").write_text("\n".join(body))
    rows = readers.read_gnss_rows(spark, str(tmp_path), contest=CONTEST).collect()
    assert sorted((r.contest_id, r.t_rel_ns, r.rule) for r in rows) == [(m, t, None) for m in ("m1", "m2") for t in (0, 1_000_000_000)]


def test_positions_without_a_kick_off_are_set_aside(spark, tmp_path):
    for match in ("m1", "m2"):
        (tmp_path / f"match={match}").mkdir()
        frames = "".join(f'<Frame N="{n}" T="2024-01-01T10:00:00.{4 * n:02d}0000+00:00" X="1.0" Y="2.0"/>' for n in range(2))
        (tmp_path / f"match={match}" / "p.xml").write_text(f'<Positions><FrameSet GameSection="firstHalf" TeamId="T" PersonId="P">{frames}</FrameSet></Positions>')
    kickoff = spark.createDataFrame([("m1", 1_704_103_200_000_000_000)], "contest_id string, kickoff_ns bigint")
    rows = readers.read_positions_xml(spark, str(tmp_path), kickoff, contest=CONTEST).collect()
    assert sorted((r.contest_id, r.frame, r.t_rel_ns, r.rule) for r in rows if r.contest_id == "m1") == [("m1", 0, 0, None), ("m1", 1, 40_000_000, None)]
    assert [(r.t_rel_ns, r.rule) for r in rows if r.contest_id == "m2"] == [(None, "required_field_null")] * 2


def full_walk(texts):
    """Paths with kinds, documents, occurrences, least and most, from whole trees."""
    nodes = {}

    def visit(path, value, doc, slot):
        entry = nodes.setdefault(path, [set(), set(), 0, {}])
        entry[1].add(doc)
        entry[2] += 1
        entry[3][slot] = entry[3].get(slot, 0) + 1
        if isinstance(value, dict):
            entry[0].add("object")
            for k, v in value.items():
                visit(f"{path}.{k}", v, doc, (doc, path, id(value)))
        elif isinstance(value, list):
            entry[0].add("array")
            for v in value:
                visit(f"{path}[]", v, doc, (doc, path, id(value)))
        else:
            entry[0].add({bool: "boolean", int: "integer", float: "number", str: "text", type(None): "null"}[type(value)])

    for doc, text in enumerate(texts):
        visit("$", json.loads(text), doc, doc)
    return {p: (sorted(k), len(d), n, max(s.values())) for p, (k, d, n, s) in nodes.items()}


def test_structure_equals_a_full_walk(spark, monkeypatch):
    import random

    rng = random.Random(3)

    def value(depth):
        kind = rng.randrange(7 if depth else 5)
        if kind >= 5:
            return {rng.choice("abc"): value(depth - 1) for _ in range(rng.randrange(4))} if kind == 5 else [value(depth - 1) for _ in range(rng.randrange(4))]
        return [None, True, 3, 2.5, "x"][kind]

    texts = [json.dumps(value(4)) for _ in range(120)]
    monkeypatch.setattr(st, "HELD", 5)
    frame = spark.createDataFrame([("k", t) for t in texts], "k string, t string").repartition(5)
    got = {r.path: (r.kinds, r.documents, r.occurrences, r.most) for r in st.structure(frame, "k", "t").collect()}
    assert got == full_walk(texts)


def test_structure_of_odd_documents(spark):
    rows = [("a", '{"x": 1, "y": [1, 2]}'), ("a", '{"x": "1"}'), ("a", "{broken"), ("a", None), (None, "[]"), (None, "[[], [1]]")]
    found = {(r.key, r.path): (r.kinds, r.documents, r.occurrences, r.least, r.most, r.optional) for r in st.structure(spark.createDataFrame(rows, "k string, t string"), "k", "t").collect()}
    assert found["a", "$"] == (["object", "unreadable"], 3, 3, 1, 1, False)
    assert found["a", "$.x"] == (["integer", "text"], 2, 2, 1, 1, False)
    assert found["a", "$.y"] == (["array"], 1, 1, 0, 1, True)
    assert found["a", "$.y[]"] == (["integer"], 1, 2, 2, 2, False)
    assert found[None, "$[]"] == (["array"], 1, 2, 0, 2, True)
    xml = st.structure(spark.createDataFrame([(1, '<a b="1"><c/><c>2.5</c></a>'), (1, "<a/>"), (1, "<a>")], "k int, t string"), "k", "t", "xml")
    found = {r.path: (r.kinds, r.occurrences, r.least, r.most, r.optional) for r in xml.collect()}
    assert found == {"/a": (["element"], 2, 1, 1, False), "/a/@b": (["integer"], 1, 0, 1, True), "/a/c": (["element"], 2, 0, 2, True), "/a/c/text()": (["number"], 1, 0, 1, True), "/": (["unreadable"], 1, 1, 1, False)}
    assert st.structure(spark.createDataFrame([], "k string, t string"), "k", "t").count() == 0


def test_structure_walks_each_document_once(spark):
    texts = ['{"a": {"b": 1}, "c": [[], [1, null], [true]]}', '{"a.b": 2.5, "a": {"b": "x"}}', '{"a": [], "c": {"b": [{"d": 1}, {"d": 2, "e": {}}]}}', "[1, {}, [2]]", "7", "not json", "{}"]
    out = st.structure(spark.createDataFrame([("k", t) for t in texts * 3], "k string, t string").repartition(1), "k", "t")
    want: dict = {}
    for text in texts * 3:
        st._add(want, "k", text, st.json_nodes)
    got = {(r.key, r.path): (r.documents, r.occurrences, r.most) for r in out.filter("path <> '$.a.b'").collect()}
    assert got == {p: (e[5], e[2], e[8]) for p, e in want.items() if p[1] != "$.a.b"}
    assert "MapInArrow" not in out._jdf.queryExecution().toString()
