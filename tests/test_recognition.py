import numpy as np

from folioflux.operators import images as I
from folioflux.operators import recognise as R
from folioflux.plans.pages import Grid, Line


def page(slope=0.0):
    image = np.full((520, 820, 3), 255, np.uint8)
    x, y = np.arange(820), np.arange(520)
    for k in range(7):
        at = np.round(60 + 60 * k + slope * (x - 410)).astype(int)
        for t in range(3):
            image[np.clip(at + t, 0, 519), x] = 0
    for k in range(6):
        at = np.round(60 + 130 * k - slope * (y - 260)).astype(int)
        for t in range(3):
            image[y, np.clip(at + t, 0, 819)] = 0
    return image


def line(text, x, y, score=0.9, wide=80, tall=12):
    return Line(text, score, x, y, x + wide, y + tall, 800, 600)


def test_grid_is_found():
    for slope in (0.0, 0.02, -0.04):
        g = I.detect_grid(page(slope))
        assert g and len(g.rows) in (7, 8) and len(g.columns) == 6, slope
        assert abs(np.median([e[0] for e in g.rows]) - slope) < 0.006
    assert I.detect_grid(np.full((300, 300, 3), 255, np.uint8)) is None


def test_text_rows():
    image = np.full((600, 800), 255, np.uint8)
    for k in range(5):
        for w in range(12):
            image[60 + 110 * k : 80 + 110 * k, 40 + 60 * w : 60 + 60 * w] = 0
    rows = I.text_rows(image)
    assert len(rows) == 5 and all(r.y1 <= 70 + 110 * k < r.y2 for k, r in enumerate(rows))
    lines = [line("a", 20, 60), line("b", 20, 170)]
    assert R.row_coverage(lines, rows) == 0.4 and R.needs_rows(lines, rows)
    assert R.row_coverage(lines, []) == 1.0


def test_blobs_join_diagonals():
    mask = np.zeros((6, 8), bool)
    mask[[0, 1, 2, 4], [0, 1, 2, 6]] = True
    b = I.blobs(mask)
    assert len(b) == 2 and sorted(b[:, 4]) == [1, 3]


def test_cells_and_warp():
    grid = Grid([(0.0, 10.0, 1.0), (0.0, 40.0, 1.0), (0.0, 70.0, 1.0)], [(0.0, 0.0, 1.0), (0.0, 50.0, 1.0)], 1.0)
    a, b = I.cells_of(grid)
    assert (a.width, a.height, a.corners[2]) == (50, 30, (50.0, 40.0)) and a.at(0.5, 0.5) == (25.0, 25.0)
    image = np.zeros((80, 60), np.uint8)
    image[20:30, 20:30] = 255
    assert I.warped(image, a.corners, a.width, a.height)[10:18, 21:28].min() > 200
    assert not I.has_ink(np.full((40, 100), 255, np.uint8))


def test_preprocessing():
    image = np.full((400, 500, 3), 200, np.uint8)
    image[:, :250] = 120  # a shadow
    for k in range(8):
        image[40 + 40 * k : 44 + 40 * k, 40:460] = 20
    flat = I.even_light(image)
    assert abs(int(flat[10, 60].mean()) - int(flat[10, 440].mean())) < 50
    out = I.preprocess(image)
    assert max(out.shape[:2]) >= 1600
    tilted = I.rotated(image, -6)
    assert abs(I.skew(tilted) - 6) < 1.5


def test_cell_merge():
    grid = Grid([(0.0, 0.0, 1.0), (0.0, 100.0, 1.0)], [(0.0, 0.0, 1.0), (0.0, 300.0, 1.0), (0.0, 600.0, 1.0)], 1.0)
    first = [line("Maria Perez", 20, 40), line("112345678", 400, 40, 0.6), line("outside", 700, 40)]
    again = [line("M#r%a", 20, 40, 0.7), line("12345678", 400, 40, 0.7), line("gone", 700, 40)]
    assert [k.text for k in R.merge_cells(first, again, grid)] == ["Maria Perez", "12345678", "outside"]


def test_policy():
    first = [line("uno dos", 20, 100, 0.5)]
    rows = [I.TextRow(0, 80, 800, 130, 1.0), I.TextRow(0, 200, 800, 250, 1.0)]
    merged = R.merge_rows(first, [line("uno", 20, 100), line("dos", 200, 102), line("tres", 20, 220)], rows)
    assert [k.text for k in merged] == ["uno dos", "tres"]
    assert R.choose(first, merged, 0.5, 1.0)[1]["motivo"] == "mejora_calidad_y_cobertura"
    assert R.choose(merged, first, 1.0, 0.5)[1]["motivo"] == "cobertura_menor"
    assert R.choose(first, first, 1.0, 1.0)[0] is first
    image = page()
    lines, audit = R.recognise(R.Recorded(first), image, I.detect_grid(image), "auto")
    assert lines == first and audit["refuerzo"]["decision"]["motivo"] == "calidad_no_mejora"
    assert R.recognise(R.Recorded(first), image, None, "printed") == (first, None)


def dots(image):
    """Reads every dark blob as a line that tells its colour."""
    b = I.blobs(I.gray(image) < 128)
    return [Line("x", 0.9, int(k[0]), int(k[1]), int(k[0] + k[2]), int(k[1] + k[3]), image.shape[1], image.shape[0]) for k in b if k[4] > 30]


def test_crops_map_back():
    image = np.full((300, 600, 3), 255, np.uint8)
    for x in (60, 290, 500):
        image[100:120, x : x + 24] = 0
    engine = R.Cropping(dots)
    row = I.TextRow(20, 80, 580, 140, 1.0)
    found = sorted(engine.rows(image, [row]), key=lambda k: k.x)
    assert [round(k.x) for k in found] == [72, 302, 512] and all(abs(k.y - 110) <= 2 for k in found)
    grid = Grid([(0.0, 70.0, 1.0), (0.0, 150.0, 1.0), (0.0, 230.0, 1.0)], [(0.0, 20.0, 1.0), (0.0, 220.0, 1.0), (0.0, 420.0, 1.0), (0.0, 580.0, 1.0)], 1.0)
    found = sorted(engine.cells(image, I.cells_of(grid)), key=lambda k: k.x)
    assert [grid.column(k) for k in found] == [0, 1, 2] and [grid.row(k) for k in found] == [0, 0, 0]
    assert all(abs(k.x - x) <= 4 for k, x in zip(found, (72, 302, 512)))
