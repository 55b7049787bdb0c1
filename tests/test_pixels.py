import numpy as np

from cadenza.operators import pixels as X


def plain_labels(mask, corners):
    """Number of connected parts and their boxes by flood fill."""
    left = {(int(y), int(x)) for y, x in zip(*np.nonzero(mask), strict=True)}
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0) and (corners or 0 in (a, b))]
    out = []
    while left:
        work, part = [left.pop()], []
        while work:
            y, x = work.pop()
            part.append((y, x))
            for a, b in steps:
                if (y + a, x + b) in left:
                    left.remove((y + a, x + b))
                    work.append((y + a, x + b))
        ys, xs = zip(*part, strict=True)
        out.append((min(xs), min(ys), max(xs) + 1, max(ys) + 1, len(part)))
    return sorted(out)


def test_components_against_flood_fill():
    rng = np.random.default_rng(0)
    for density in (0.2, 0.45, 0.7):
        for corners in (True, False):
            m = rng.random((17, 23)) < density
            assert sorted(map(tuple, X.components(m, corners).tolist())) == plain_labels(m, corners)
    assert X.components(np.zeros((3, 3), bool)).shape == (0, 5)


def test_grown_and_closed_against_loops():
    rng = np.random.default_rng(1)
    m = rng.random((12, 15)) < 0.2
    want = np.zeros_like(m)
    for y in range(12):
        for x in range(15):
            want[y, x] = m[max(0, y - 1) : y + 2, max(0, x - 2) : x + 3].any()
    assert (X.grown(m, 3, 5) == want).all()
    assert (X.closed(m, 3, 5) | m == X.closed(m, 3, 5)).all()


def test_outlines_leave_out_what_is_surrounded():
    m = np.zeros((20, 20), bool)
    m[2:15, 2:15] = True
    m[4:13, 4:13] = False
    m[7:9, 7:9] = True
    m[17:19, 17:19] = True
    assert sorted(map(tuple, X.outlines(m)[:, :4].tolist())) == [(2, 2, 15, 15), (17, 17, 19, 19)]


def test_grey_and_saturation():
    f = np.array([[[0, 0, 0], [255, 255, 255], [0, 0, 255], [10, 20, 40]]], np.uint8)
    assert X.grey(f).tolist() == [[0, 255, 76, 25]] and X.saturation(f).tolist() == [[0, 0, 255, 191]]


def test_edges_of_a_step():
    g = np.zeros((12, 12), np.int64)
    g[:, 6:] = 200
    e = X.edges(g)
    assert e.any() and e[:, :4].sum() == 0 and e[:, 8:].sum() == 0 and set(e.sum(1).tolist()) == {1}
    assert not X.edges(np.full((8, 8), 100)).any()


def scene(text, high=10):
    f = np.full((200, 300, 3), 40, np.uint8)
    if text:
        for k in range(14):
            f[140 : 140 + high, 60 + 12 * k : 64 + 12 * k] = 240
    return f


def test_text_is_seen_and_added():
    assert X.has_text(scene(True)) and X.has_text(scene(True), X.STRICT) and not X.has_text(scene(False))
    boxes = X.components(X.text_mask(scene(True)))
    assert len(boxes) >= 1 and boxes[:, 1].min() >= 135
    added = X.added_mask(scene(True), scene(False))
    assert added[140:150].any() and not added[:130].any() and not X.added_mask(scene(True), scene(True)).any()
    assert len(X.outline_boxes(scene(True))) == 0 and len(X.outline_boxes(scene(True, 18))) == 1


def test_frames_as_rows(spark):
    rows = [("v", 1, 300, 200, bytearray(scene(True).tobytes())), ("v", 2, 300, 200, None), ("v", 3, 300, 200, bytearray(b"xx"))]
    df = spark.createDataFrame(rows, "video_id string, frame_id int, frame_width int, frame_height int, pixels binary")
    got = {r.frame_id: r for r in X.analysed(df).collect()}
    assert got[1].visible and got[1].readable and not got[2].readable and got[3].visible is None
