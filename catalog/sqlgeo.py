"""SQL text for the projection formulas used by several oracles."""


def den(w, policy="null"):
    return {
        "null": f"CASE WHEN abs({w}) >= 1e-12 THEN {w} END",
        "clamp": f"CASE WHEN abs({w}) < 1e-10 THEN 1e-10 ELSE {w} END",
        "clamp9": f"CASE WHEN abs({w}) < 1e-9 THEN 1e-9 ELSE {w} END",
        "floor9": f"greatest({w}, 1e-9)",
    }[policy]


def px(h, u, v, policy="null"):
    return f"(({h}[1]*({u}) + {h}[2]*({v}) + {h}[3]) / ({den(f'({h}[7]*({u}) + {h}[8]*({v}) + {h}[9])', policy)}))"


def py(h, u, v, policy="null"):
    return f"(({h}[4]*({u}) + {h}[5]*({v}) + {h}[6]) / ({den(f'({h}[7]*({u}) + {h}[8]*({v}) + {h}[9])', policy)}))"


CORNERS = [("100e0", "100e0"), ("1180e0", "100e0"), ("1180e0", "620e0"), ("100e0", "620e0")]


def corner_list(h):
    """Eight projected corner coordinates as a list, NULL without h."""
    cells = []
    for u, v in CORNERS:
        cells += [px(h, u, v, "clamp9"), py(h, u, v, "clamp9")]
    return f"CASE WHEN {h} IS NOT NULL THEN [{', '.join(cells)}] END"


def gap(a, b):
    """Largest corner distance between two corner lists."""
    parts = [f"sqrt(({a}[{2*i+1}]-{b}[{2*i+1}])*({a}[{2*i+1}]-{b}[{2*i+1}]) + ({a}[{2*i+2}]-{b}[{2*i+2}])*({a}[{2*i+2}]-{b}[{2*i+2}]))"
             for i in range(4)]
    return f"greatest({', '.join(parts)})"


def inverse(h):
    a, b, c, d, e, f, g, i, j = [f"{h}[{n}]" for n in range(1, 10)]
    co = [f"({e}*{j} - {f}*{i})", f"({c}*{i} - {b}*{j})", f"({b}*{f} - {c}*{e})",
          f"({f}*{g} - {d}*{j})", f"({a}*{j} - {c}*{g})", f"({c}*{d} - {a}*{f})",
          f"({d}*{i} - {e}*{g})", f"({b}*{g} - {a}*{i})", f"({a}*{e} - {b}*{d})"]
    det = f"({a}*{co[0]} + {b}*{co[3]} + {c}*{co[6]})"
    return f"CASE WHEN {det} <> 0 THEN [{', '.join(f'{x}/{det}' for x in co)}] END"


def product(p, q):
    cells = [f"{p}[{3*r+1}]*{q}[{c+1}] + {p}[{3*r+2}]*{q}[{c+4}] + {p}[{3*r+3}]*{q}[{c+7}]"
             for r in range(3) for c in range(3)]
    return f"[{', '.join(cells)}]"


def iou(a, b, factor):
    """Expanded IoU of two boxes given as 4-tuples of SQL expressions."""
    s = f"{1.0 + factor}e0"

    def lo(x, y):
        return f"((({x})+({y}))*0.5e0 - (({y})-({x}))*0.5e0*{s})"

    def hi(x, y):
        return f"((({x})+({y}))*0.5e0 + (({y})-({x}))*0.5e0*{s})"

    iw = f"greatest(least({hi(a[0], a[2])}, {hi(b[0], b[2])}) - greatest({lo(a[0], a[2])}, {lo(b[0], b[2])}), 0e0)"
    ih = f"greatest(least({hi(a[1], a[3])}, {hi(b[1], b[3])}) - greatest({lo(a[1], a[3])}, {lo(b[1], b[3])}), 0e0)"
    inter = f"({iw}*{ih})"

    def area(q):
        return f"(({hi(q[0], q[2])}-{lo(q[0], q[2])})*({hi(q[1], q[3])}-{lo(q[1], q[3])}))"

    union = f"({area(a)} + {area(b)} - {inter})"
    solid = f"({a[2]} > {a[0]} AND {a[3]} > {a[1]} AND {b[2]} > {b[0]} AND {b[3]} > {b[1]})"
    return f"CASE WHEN {solid} AND {inter} > 0 AND {union} > 0 THEN {inter}/{union} ELSE 0e0 END"
