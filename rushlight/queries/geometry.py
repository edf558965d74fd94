"""Rotation, camera, encoding and text functions on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rushlight.functions import cameras as cam
from rushlight.functions import encoding as enc
from rushlight.functions import geometry as g
from rushlight.functions import text
from rushlight.queries.registry import query
from rushlight.queries.views import EVENTS, events, rounded, vectors, vectors_sql
from rushlight.session import table

DIMS = {n: i + 1 for i, n in enumerate("aw ax ay az gw gx gy gz px py pz tx ty tz".split())}
# both quaternions at unit length: the input of most queries here
UNIT = (
    vectors_sql(DIMS)
    + """,
unit_v AS (SELECT vec_id, label, px, py, pz, tx, ty, tz,
    aw / na AS aw, ax / na AS ax, ay / na AS ay, az / na AS az, gw / nb AS gw, gx / nb AS gx, gy / nb AS gy, gz / nb AS gz
  FROM (SELECT *, greatest(sqrt(aw * aw + ax * ax + ay * ay + az * az), 1e-12) AS na,
    greatest(sqrt(gw * gw + gx * gx + gy * gy + gz * gz), 1e-12) AS nb FROM vectors_v))"""
)


def rotation_sql(w="aw", x="ax", y="ay", z="az"):
    """Nine row-major entries of the rotation matrix."""
    return [
        f"(1 - 2 * ({y} * {y} + {z} * {z}))", f"(2 * ({x} * {y} - {w} * {z}))", f"(2 * ({x} * {z} + {w} * {y}))",
        f"(2 * ({x} * {y} + {w} * {z}))", f"(1 - 2 * ({x} * {x} + {z} * {z}))", f"(2 * ({y} * {z} - {w} * {x}))",
        f"(2 * ({x} * {z} - {w} * {y}))", f"(2 * ({y} * {z} + {w} * {x}))", f"(1 - 2 * ({x} * {x} + {y} * {y}))",
    ]


M = rotation_sql()


def times(row, v=("px", "py", "pz")):
    return "(" + " + ".join(f"{M[3 * row + i]} * {v[i]}" for i in range(3)) + ")"


def times_t(row, v=("px", "py", "pz")):
    return "(" + " + ".join(f"{M[3 * i + row]} * {v[i]}" for i in range(3)) + ")"


MULTIPLY = {
    "w": "aw * gw - ax * gx - ay * gy - az * gz",
    "x": "aw * gx + ax * gw + ay * gz - az * gy",
    "y": "aw * gy - ax * gz + ay * gw + az * gx",
    "z": "aw * gz + ax * gy - ay * gx + az * gw",
}


def unit(spark, folder):
    rows = vectors(spark, folder, DIMS)
    made = g.named(g.quat_normalise(g.vec("aw", "ax", "ay", "az")), "aw", "ax", "ay", "az")
    made |= g.named(g.quat_normalise(g.vec("gw", "gx", "gy", "gz")), "gw", "gx", "gy", "gz")
    return rows.withColumns(made)


def parts():
    """The two quaternions, the point and the translation of a row."""
    return g.vec("aw", "ax", "ay", "az"), g.vec("gw", "gx", "gy", "gz"), g.vec("px", "py", "pz"), g.vec("tx", "ty", "tz")


def pick(rows, *groups, digits=6):
    """``vec_id`` and (prefix, names, values) groups, rounded."""
    made = [v.alias(f"{prefix}{n}") for prefix, names, values in groups for n, v in zip(names, values, strict=True)]
    return rounded(rows.select("vec_id", *made), digits)


@query(
    "fn1_quaternions",
    f"""WITH {UNIT}, d AS (SELECT *, CASE WHEN aw * gw + ax * gx + ay * gy + az * gz < 0 THEN -1.0 ELSE 1.0 END AS s FROM unit_v),
    n AS (SELECT *, aw + (s * gw - aw) * 0.25 AS lw, ax + (s * gx - ax) * 0.25 AS lx, ay + (s * gy - ay) * 0.25 AS ly,
      az + (s * gz - az) * 0.25 AS lz FROM d)
    SELECT vec_id, {", ".join(f"round({e}, 6) AS m{k}" for k, e in MULTIPLY.items())},
      {", ".join(f"round({times(i)}, 6) AS r{k}" for i, k in enumerate("xyz"))},
      {", ".join(f"round(l{k} / sqrt(lw * lw + lx * lx + ly * ly + lz * lz), 6) AS n{k}" for k in "wxyz")} FROM n""",
)
def quaternions(spark, folder):
    A, B, P, _ = parts()
    rows = unit(spark, folder)
    return pick(
        rows,
        ("m", "wxyz", g.quat_multiply(A, B)),
        ("r", "xyz", g.quat_rotate(A, P)),
        ("n", "wxyz", g.nlerp(A, B, F.lit(0.25))),
    )


@query(
    "fn2_matrix_round_trip",
    f"""WITH {UNIT}, s AS (SELECT *, CASE WHEN 1 + ({M[0]} + {M[4]} + {M[8]}) > 1 THEN sign(aw)
        WHEN {M[0]} > {M[4]} AND {M[0]} > {M[8]} THEN sign(ax) WHEN {M[4]} > {M[8]} THEN sign(ay) ELSE sign(az) END AS s FROM unit_v)
    SELECT vec_id, {", ".join(f"round({e}, 6) AS m{i}" for i, e in enumerate(M))},
      {", ".join(f"round(a{k} * s, 6) AS q{k}" for k in "wxyz")} FROM s""",
)
def matrix_round_trip(spark, folder):
    A, _, _, _ = parts()
    m = g.quat_to_matrix(A)
    names = [[f"_m{r}{c}" for c in range(3)] for r in range(3)]
    rows = unit(spark, folder).withColumns({names[r][c]: m[r][c] for r in range(3) for c in range(3)})
    back = g.matrix_to_quat(tuple(g.vec(*row) for row in names))
    flat = tuple(F.col(n) for row in names for n in row)
    return pick(rows, ("m", "012345678", flat), ("q", "wxyz", back))


@query(
    "fn2_axis_angle",
    f"""WITH {UNIT}, h AS (SELECT *, sqrt(px * px + py * py + pz * pz) AS th, CASE WHEN aw < 0 THEN -1.0 ELSE 1.0 END AS s FROM unit_v)
    SELECT vec_id, round(cos(th / 2), 6) AS ew, {", ".join(f"round(p{k} * sin(th / 2) / th, 6) AS e{k}" for k in "xyz")},
      {", ".join(f"round(s * a{k} * 2 * atan2(sqrt(ax * ax + ay * ay + az * az), s * aw) / sqrt(ax * ax + ay * ay + az * az), 6) AS l{k}" for k in "xyz")}
    FROM h""",
)
def axis_angle(spark, folder):
    A, _, P, _ = parts()
    return pick(unit(spark, folder), ("e", "wxyz", g.axis_angle_to_quat(P)), ("l", "xyz", g.quat_to_axis_angle(A)))


@query(
    "fn3_angular_error",
    f"""WITH {UNIT} SELECT vec_id, round(degrees(2 * atan2(sqrt(
      pow(aw * gx - ax * gw - ay * gz + az * gy, 2) + pow(aw * gy + ax * gz - ay * gw - az * gx, 2)
      + pow(aw * gz - ax * gy + ay * gx - az * gw, 2)), abs(aw * gw + ax * gx + ay * gy + az * gz))), 6) AS degrees FROM unit_v""",
)
def angular_error(spark, folder):
    A, B, _, _ = parts()
    return rounded(unit(spark, folder).select("vec_id", g.angular_error_degrees(A, B).alias("degrees")))


@query(
    "fn4_camera_frames",
    f"""WITH {UNIT} SELECT vec_id,
      {", ".join(f"round(-{times_t(i, ('tx', 'ty', 'tz'))}, 6) AS eye_{k}" for i, k in enumerate("xyz"))},
      {", ".join(f"round({M[6 + i]}, 6) AS forward_{k}" for i, k in enumerate("xyz"))},
      {", ".join(f"round(-{M[3 + i]}, 6) AS up_{k}" for i, k in enumerate("xyz"))},
      {", ".join(f"round({'-' if c else ''}{M[3 * c + r]}, 6) AS gl{r}{c}" for r in range(3) for c in range(3))} FROM unit_v""",
)
def camera_frames(spark, folder):
    A, _, _, T = parts()
    rows = unit(spark, folder)
    frame = g.capture_frame(A, T)
    pose = g.opengl_pose(A, T)
    gl = [pose[r * 4 + c].alias(f"gl{r}{c}") for r in range(3) for c in range(3)]
    return rounded(rows.select("vec_id", *[v.alias(n) for n, v in frame.items()], *gl))


SEEN = [f"({times(i)} + t{k})" for i, k in enumerate("xyz")]


@query(
    "fn5_project",
    f"""WITH {UNIT} SELECT vec_id, CASE WHEN {SEEN[2]} > 1e-6 THEN round(500 * {SEEN[0]} / {SEEN[2]} + 320, 4) END AS u,
      CASE WHEN {SEEN[2]} > 1e-6 THEN round(510 * {SEEN[1]} / {SEEN[2]} + 240, 4) END AS v FROM unit_v""",
)
def project(spark, folder):
    A, _, P, T = parts()
    rows = unit(spark, folder).withColumns(g.named(g.to_camera(P, A, T), "sx", "sy", "sz"))
    pixel = g.project(g.vec("sx", "sy", "sz"), F.lit(500.0), F.lit(510.0), F.lit(320.0), F.lit(240.0))
    return pick(rows, ("", "uv", pixel), digits=4)


@query(
    "fn6_rotation_to_y_up",
    f"""WITH {UNIT}, u AS (SELECT vec_id, px / n AS x, py / n AS y, pz / n AS z FROM (SELECT *, sqrt(px * px + py * py + pz * pz) AS n FROM unit_v))
    SELECT vec_id, round(y + z * z / (1 + y), 6) AS m00, round(x, 6) AS m10, round(-x * z / (1 + y), 6) AS m02, round(z, 6) AS m12,
      round(y + x * x / (1 + y), 6) AS m22, 0.0 AS vx, 1.0 AS vy, 0.0 AS vz FROM u""",
)
def y_up(spark, folder):
    _, _, P, _ = parts()
    n = g.length(P)
    rows = unit(spark, folder).withColumns(g.named(tuple(c / n for c in P), "px", "py", "pz"))
    m = g.rotation_to_y_up(P)
    turned = [(F.round(v, 6) + 0.0) for v in g.apply(m, P)]  # the up direction itself must land on +Y
    made = {"m00": m[0][0], "m10": m[1][0], "m02": m[0][2], "m12": m[1][2], "m22": m[2][2]}
    made |= dict(zip(("vx", "vy", "vz"), turned, strict=True))
    return rounded(rows.select("vec_id", *[v.alias(n) for n, v in made.items()]))


DEVICE = """device_v AS (SELECT event_id, 2760.6787 + k AS fx, 2758.1523 + k AS fy, 2030.894 AS cx, 1550.8883 AS cy,
    CASE event_type WHEN 'click' THEN 90 WHEN 'view' THEN 180 WHEN 'error' THEN 270 WHEN 'signup' THEN 45 ELSE 0 END AS rotation,
    CASE WHEN event_type IN ('click', 'error') THEN 1080 ELSE 1920 END AS fw, CASE WHEN event_type IN ('click', 'error') THEN 1920 ELSE 1080 END AS fh
  FROM events_v),
scaled_v AS (SELECT event_id, rotation, fx * 1920 / 4080 AS fx, fy * 1920 / 4080 AS fy, cx * 1920 / 4080 AS cx,
    (cy - (3060 - 1080 * 4080 / 1920.0) / 2) * 1920 / 4080 AS cy, 1920.0 AS w, 1080.0 AS h FROM device_v)"""


@query(
    "fn7_device_intrinsics",
    f"""WITH {EVENTS}, {DEVICE} SELECT event_id,
      CASE WHEN rotation % 180 = 90 THEN round(fy, 4) WHEN rotation = 45 THEN NULL ELSE round(fx, 4) END AS fx,
      CASE WHEN rotation % 180 = 90 THEN round(fx, 4) WHEN rotation = 45 THEN NULL ELSE round(fy, 4) END AS fy,
      round(CASE rotation WHEN 0 THEN cx WHEN 90 THEN h - cy WHEN 180 THEN w - cx WHEN 270 THEN cy END, 4) AS cx,
      round(CASE rotation WHEN 0 THEN cy WHEN 90 THEN cx WHEN 180 THEN h - cy WHEN 270 THEN w - cx END, 4) AS cy,
      CASE WHEN rotation = 45 THEN NULL WHEN rotation % 180 = 90 THEN h ELSE w END AS width,
      CASE WHEN rotation <> 45 THEN CAST(0.0796 AS DOUBLE) END AS k1,
      CASE WHEN rotation <> 45 THEN TRUE END AS plausible FROM scaled_v""",
)
def device_intrinsics(spark, folder):
    kind = F.col("event_type")
    rotation = F.when(kind == "click", 90).when(kind == "view", 180).when(kind == "error", 270).when(kind == "signup", 45).otherwise(0)
    sideways = kind.isin("click", "error")
    document = F.to_json(
        F.struct(
            F.struct(
                (F.lit(2760.6787) + F.col("k")).alias("fx"), (F.lit(2758.1523) + F.col("k")).alias("fy"),
                F.lit(2030.894).alias("cx"), F.lit(1550.8883).alias("cy"),
            ).alias("intrinsic_calibration"),
            F.struct(F.lit(4080).alias("width"), F.lit(3060).alias("height")).alias("pre_correction_active_array"),
            F.array(*[F.lit(v) for v in (0.0796, -0.1144, 0.0451, 0.0, 0.0)]).alias("distortion_kappa"),
        )
    )
    made = cam.device_intrinsics(
        document, F.when(sideways, 1080).otherwise(1920), F.when(sideways, 1920).otherwise(1080), rotation
    )
    rows = events(spark, folder).select("event_id", made.alias("i"))
    return rounded(
        rows.select(
            "event_id", "i.fx", "i.fy", "i.cx", "i.cy", "i.width", "i.k1", cam.plausible_intrinsics(F.col("i")).alias("plausible")
        ),
        4,
    )


@query(
    "flt6_plausible_intrinsics",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice,
      abs(l_extendedprice / 100 - 500) <= 80 AND abs(l_quantity * 20 - 400) <= 64 AND l_discount > 0 AND l_tax > 0 AS plausible FROM lineitem""",
)
def plausible(spark, folder):
    k = F.struct(
        (F.col("l_extendedprice") / 100).alias("cx"), (F.col("l_quantity") * 20).alias("cy"), F.lit(1000).alias("width"),
        F.lit(800).alias("height"), F.col("l_discount").alias("fx"), F.col("l_tax").alias("fy"),
    )
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", k.alias("k"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", cam.plausible_intrinsics(F.col("k")).alias("plausible"))


PACKED = [
    f"CAST(round_even(greatest(-1, least(1, q[i{p}] * s / 0.7071067811865476)) * 511, 0) + 511 AS BIGINT)" for p in range(3)
]


@query(
    "fn9_pack_quat32",
    f"""WITH {UNIT}, a AS (SELECT vec_id, [aw, ax, ay, az] AS q, list_position([abs(aw), abs(ax), abs(ay), abs(az)],
        list_max([abs(aw), abs(ax), abs(ay), abs(az)])) AS l FROM unit_v),
    b AS (SELECT *, CASE WHEN q[l] < 0 THEN -1.0 ELSE 1.0 END AS s, CASE WHEN l > 1 THEN 1 ELSE 2 END AS i0,
      CASE WHEN l > 2 THEN 2 ELSE 3 END AS i1, CASE WHEN l > 3 THEN 3 ELSE 4 END AS i2 FROM a),
    w AS (SELECT *, {", ".join(f"{e} AS c{i}" for i, e in enumerate(PACKED))} FROM b),
    k AS (SELECT *, (c0 - 511) / 511.0 * CAST(0.7071067811865476 AS DOUBLE) AS k0, (c1 - 511) / 511.0 * CAST(0.7071067811865476 AS DOUBLE) AS k1,
      (c2 - 511) / 511.0 * CAST(0.7071067811865476 AS DOUBLE) AS k2 FROM w),
    r AS (SELECT *, sqrt(greatest(0, 1 - k0 * k0 - k1 * k1 - k2 * k2)) AS kl FROM k)
    SELECT vec_id, CAST(CAST(l - 1 AS BIGINT) * 1073741824 + c0 * 1048576 + c1 * 1024 + c2 AS BIGINT) AS word,
      round((CASE l WHEN 1 THEN kl ELSE k0 END) / sqrt(k0 * k0 + k1 * k1 + k2 * k2 + kl * kl), 6) AS uw,
      round((CASE l WHEN 1 THEN k0 WHEN 2 THEN kl ELSE k1 END) / sqrt(k0 * k0 + k1 * k1 + k2 * k2 + kl * kl), 6) AS ux,
      round((CASE l WHEN 4 THEN kl ELSE k2 END) / sqrt(k0 * k0 + k1 * k1 + k2 * k2 + kl * kl), 6) AS uz FROM r""",
)
def pack_quat32(spark, folder):
    A, _, _, _ = parts()
    rows = unit(spark, folder).select("vec_id", enc.pack_quat32(A).alias("word"))
    back = enc.unpack_quat32(F.col("word"))
    return rounded(rows.select("vec_id", "word", back[0].alias("uw"), back[1].alias("ux"), back[3].alias("uz")))


@query(
    "fn10_pack_quat_snorm16",
    f"""WITH {UNIT}, c AS (SELECT vec_id, {", ".join(f"CAST(greatest(-32767, least(32767, round_even(a{k} * 32767, 0))) AS INT) AS c{k}" for k in "wxyz")} FROM unit_v)
    SELECT *, round(cw / sqrt(CAST(cw AS DOUBLE) * cw + CAST(cx AS DOUBLE) * cx + CAST(cy AS DOUBLE) * cy + CAST(cz AS DOUBLE) * cz), 6) AS uw FROM c""",
)
def pack_snorm16(spark, folder):
    A, _, _, _ = parts()
    codes = enc.pack_quat_snorm16(A)
    rows = unit(spark, folder).select("vec_id", *[c.alias(f"c{k}") for c, k in zip(codes, "wxyz", strict=True)])
    back = enc.unpack_quat_snorm16(g.vec("cw", "cx", "cy", "cz"))
    return rounded(rows.select("*", back[0].alias("uw")))


@query(
    "fn11_quantise_weights",
    f"""WITH {UNIT}, w AS (SELECT vec_id, [abs(aw), abs(ax), abs(ay), abs(az)] AS w FROM unit_v),
    s AS (SELECT vec_id, list_transform(w, lambda v: v / greatest(list_sum(w), 1e-12) * 255.0) AS s FROM w),
    e AS (SELECT vec_id, unnest(s) AS v, unnest([0, 1, 2, 3]) AS i FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY floor(v) - v, i) AS rk, 255 - sum(floor(v)) OVER (PARTITION BY vec_id) AS spare FROM e)
    SELECT vec_id, i, CAST(floor(v) + CASE WHEN rk <= spare THEN 1 ELSE 0 END AS INT) AS code FROM r""",
)
def quantise_weights(spark, folder):
    A, _, _, _ = parts()
    rows = unit(spark, folder).select("vec_id", F.array(*[F.abs(c) for c in A]).alias("w"))
    rows = rows.select("vec_id", enc.quantise_weights(F.col("w")).alias("codes"))
    return rows.select("vec_id", F.posexplode("codes").alias("i", "code"))


@query(
    "fn11_dequantise_weights",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity / 255.0, 9) AS weight FROM lineitem""",
)
def dequantise_weights(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", enc.dequantise_weights(F.array("l_quantity")).alias("w")
    )
    return rounded(rows.select("l_orderkey", "l_linenumber", "l_partkey", F.get("w", F.lit(0)).alias("weight")), 9)


LOGS = """logs_v AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'Iteration ' || n_chars || '/30000' WHEN 'de' THEN 'step: ' || n_chars || ' loss 0.01'
    WHEN 'fr' THEN 'loss ' || n_chars ELSE 'steps taken ' || n_chars END AS line FROM documents)"""


@query(
    "fn15_parse_progress",
    f"""WITH {LOGS}, v AS (SELECT doc_id, TRY_CAST(nullif(regexp_extract(line, '(?i)(?:iter(?:ation)?|step)\\D{{0,4}}(\\d{{2,7}})', 1), '') AS BIGINT) AS v FROM logs_v)
    SELECT doc_id, CASE WHEN v > 0 AND v <= 30000 THEN least(95, CAST(trunc(v / 30000.0 * 95) AS INT)) END AS percent FROM v""",
)
def parse_progress(spark, folder):
    lang, n = F.col("lang"), F.col("n_chars").cast("string")
    line = (
        F.when(lang == "en", F.concat(F.lit("Iteration "), n, F.lit("/30000")))
        .when(lang == "de", F.concat(F.lit("step: "), n, F.lit(" loss 0.01")))
        .when(lang == "fr", F.concat(F.lit("loss "), n))
        .otherwise(F.concat(F.lit("steps taken "), n))
    )
    return table(spark, folder, "documents").select("doc_id", text.parse_progress(line, F.lit(30000)).alias("percent"))


@query(
    "fn15_parse_progress_documents",
    """WITH v AS (SELECT doc_id, TRY_CAST(nullif(regexp_extract(text, '(?i)(?:iter(?:ation)?|step)\\D{0,4}(\\d{2,7})', 1), '') AS BIGINT) AS v FROM documents)
    SELECT doc_id, CASE WHEN v > 0 AND v <= 9999999 THEN least(95, CAST(trunc(v / 9999999.0 * 95) AS INT)) END AS percent FROM v""",
)
def parse_progress_documents(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.parse_progress(F.col("text"), F.lit(9999999)).alias("percent"))


@query(
    "fn14_parse_rate",
    f"""WITH {EVENTS}, r AS (SELECT event_id, CASE event_type WHEN 'click' THEN CAST(CAST(k AS INT) * 1000 AS VARCHAR) || '/1001' WHEN 'view' THEN CAST(CAST(k AS INT) AS VARCHAR) || '/0'
        WHEN 'error' THEN 'n/a' ELSE CAST(CAST(k AS INT) AS VARCHAR) || '.5' END AS rate, CAST(k AS INT) * 90 - 900 AS turn FROM events_v)
    SELECT event_id, CASE WHEN rate LIKE '%/1001' THEN round(CAST(split_part(rate, '/', 1) AS DOUBLE) / 1001, 6) WHEN rate LIKE '%/%' THEN NULL
      ELSE round(TRY_CAST(rate AS DOUBLE), 6) END AS fps, ((turn % 360) + 360) % 360 AS rotation,
      CASE WHEN abs(turn) % 180 = 90 THEN 1080 ELSE 1920 END AS width FROM r""",
)
def parse_rate(spark, folder):
    kind, k = F.col("event_type"), F.col("k").cast("int")
    rate = (
        F.when(kind == "click", F.concat((k * 1000).cast("string"), F.lit("/1001")))
        .when(kind == "view", F.concat(k.cast("string"), F.lit("/0")))
        .when(kind == "error", "n/a")
        .otherwise(F.concat(k.cast("string"), F.lit(".5")))
    )
    turn = text.quarter_turns((k * 90 - 900).cast("string"))
    rows = events(spark, folder).select("event_id", text.parse_rate(rate).alias("fps"), turn.alias("rotation"))
    size = text.display_size(F.lit(1920), F.lit(1080), F.col("rotation"))
    return rounded(rows.select("event_id", "fps", "rotation", size["width"].alias("width")))


@query(
    "fn16_labels",
    """SELECT o_orderkey, CASE WHEN b >= 1073741824 THEN format('{:.1f} GB', round_even(b / 1073741824.0, 1))
        WHEN b >= 1048576 THEN format('{:.0f} MB', round_even(b / 1048576.0, 0)) ELSE format('{:.0f} KB', round_even(b / 1024.0, 0)) END AS size,
      'A ' || lower(o_orderstatus) || ' · ' || format('{:,}', o_custkey) || ' steps' AS label
    FROM (SELECT *, CAST(floor(o_totalprice * o_totalprice / 100) AS BIGINT) AS b FROM orders)""",
)
def labels(spark, folder):
    size = text.human_size(F.floor(F.col("o_totalprice") * F.col("o_totalprice") / 100))
    stem = F.concat_ws("_", F.lit("A"), F.lower("o_orderstatus"), F.col("o_custkey").cast("string"))
    return table(spark, folder, "orders").select("o_orderkey", size.alias("size"), text.short_label(stem).alias("label"))


@query(
    "fn18_loss_mask_weight",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(CAST(0.1 AS DOUBLE) + CAST(0.9 AS DOUBLE) * (l_quantity / 255.0), 9) AS weight FROM lineitem""",
)
def loss_mask_weight(spark, folder):
    rows = table(spark, folder, "lineitem")
    return rounded(rows.select("l_orderkey", "l_linenumber", "l_partkey", enc.loss_mask_weight(F.col("l_quantity")).alias("weight")), 9)


@query(
    "fn20_payload_bytes",
    """WITH c AS (SELECT l_suppkey AS scene_id, count(*) AS n, count(CASE WHEN l_linestatus = 'F' THEN 1 END) AS d,
        count(DISTINCT l_shipdate) AS t, count(DISTINCT l_linenumber) AS k FROM lineitem GROUP BY 1)
    SELECT scene_id, n * 16 AS geometry_bytes, n * 4 AS colour_bytes, d * 8 AS skin_bytes, t * k * 14 AS trajectory_bytes, k * 12 AS node_bytes,
      n * 20 + d * 8 + t * k * 14 + k * 12 AS total_bytes, round((n * 20 + d * 8 + t * k * 14 + k * 12) / CAST(n AS DOUBLE), 6) AS bytes_per_gaussian,
      round((t - 1) / 30.0, 6) AS clip_seconds FROM c""",
)
def payload_bytes(spark, folder):
    scenes = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("scene_id")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("d"),
        F.count_distinct("l_shipdate").alias("t"), F.count_distinct("l_linenumber").alias("k"),
    )
    made = enc.payload_bytes(F.col("n"), F.col("d"), F.col("t"), F.col("k"), F.lit(4))
    seconds = enc.clip_seconds(F.col("t"), F.lit(30.0))
    return rounded(scenes.select("scene_id", *[v.alias(n) for n, v in made.items()], seconds.alias("clip_seconds")))
