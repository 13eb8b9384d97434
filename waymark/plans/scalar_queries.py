"""Scalar functions (H) on driver columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import angles, names, text
from waymark.functions import geometry as g
from waymark.plans.registry import query
from waymark.plans.sqltext import ARRIVALS_SQL, QUALIFIERS_SQL, SIDES_SQL, TEMPLATES_SQL, UNITS_SQL, speak_sql

# Orientation of one event: yaw from the value column, pitch from the id.
EVENT_QUAT_SQL = """
ev AS (SELECT event_id, radians(value % 360)/2 AS hy, radians((event_id*7) % 61 - 30.0)/2 AS hp,
              CAST((event_id*37) % 11 - 5 AS DOUBLE) AS tx, CAST((event_id*53) % 11 - 5 AS DOUBLE) AS ty,
              CAST((event_id*29) % 11 - 5 AS DOUBLE) AS tz
       FROM events),
q AS (SELECT *, cos(hy)*cos(hp) AS w, cos(hy)*sin(hp) AS x, sin(hy)*cos(hp) AS y, -sin(hy)*sin(hp) AS z FROM ev),
r AS (SELECT *, 1-2*(y*y+z*z) AS r00, 2*(x*y-w*z) AS r01, 2*(x*z+w*y) AS r02,
             2*(x*y+w*z) AS r10, 1-2*(x*x+z*z) AS r11, 2*(y*z-w*x) AS r12,
             2*(x*z-w*y) AS r20, 2*(y*z+w*x) AS r21, 1-2*(x*x+y*y) AS r22 FROM q)
"""


def event_poses(t):
    """events -> event_id, quaternion (w,x,y,z) of yaw then pitch, translation, rotation r0..r8."""
    half_yaw = F.radians(F.col("value") % 360) / 2
    half_pitch = F.radians((F.col("event_id") * 7) % 61 - 30.0) / 2
    ev = t.events.select(
        "event_id",
        half_yaw.alias("hy"),
        half_pitch.alias("hp"),
        ((F.col("event_id") * 37) % 11 - 5).cast("double").alias("tx"),
        ((F.col("event_id") * 53) % 11 - 5).cast("double").alias("ty"),
        ((F.col("event_id") * 29) % 11 - 5).cast("double").alias("tz"),
    )
    o = F.lit(0.0)
    yaw_q = [F.cos("hy"), o, F.sin("hy"), o]
    pitch_q = [F.cos("hp"), F.sin("hp"), o, o]
    q = g.quat_multiply(yaw_q, pitch_q)
    ev = ev.select("event_id", "tx", "ty", "tz", *[c.alias(n) for c, n in zip(q, "wxyz")])
    rot = g.quat_to_rot([F.col(c) for c in "wxyz"])
    return ev.select("*", *[c.alias(f"r{i}") for i, c in enumerate(rot)])


ROT = [F"r{i}" for i in range(9)]


def rot_cols():
    return [F.col(c) for c in ROT]


def trans_cols():
    return [F.col(c) for c in ("tx", "ty", "tz")]


@query(
    "quat_rot",
    f"""WITH {EVENT_QUAT_SQL}
    SELECT event_id, round(r00,6)+0.0 AS r00, round(r02,6)+0.0 AS r02, round(r12,6)+0.0 AS r12, round(r20,6)+0.0 AS r20,
           round(abs(w),6)+0.0 AS back_w, round(sign(w)*x,6)+0.0 AS back_x, round(sign(w)*y,6)+0.0 AS back_y,
           round(sign(w)*z,6)+0.0 AS back_z
    FROM r""",
)
def quat_rot(t):
    p = event_poses(t)
    back = g.rot_to_quat(rot_cols())
    return p.select(
        "event_id",
        *[g.clean(F.col(f"r{i}")).alias(n) for i, n in ((0, "r00"), (2, "r02"), (5, "r12"), (6, "r20"))],
        *[g.clean(c).alias(f"back_{n}") for c, n in zip(back, "wxyz")],
    )


@query(
    "camera_center",
    f"""WITH {EVENT_QUAT_SQL}
    SELECT event_id,
       round(-(r00*tx+r10*ty+r20*tz),6)+0.0 AS cx, round(-(r01*tx+r11*ty+r21*tz),6)+0.0 AS cy,
       round(-(r02*tx+r12*ty+r22*tz),6)+0.0 AS cz,
       round(r20,6)+0.0 AS fx, round(r21,6)+0.0 AS fy, round(r22,6)+0.0 AS fz
    FROM r""",
)
def camera_center(t):
    centre = g.camera_center(rot_cols(), trans_cols())
    ahead = g.forward_axis(rot_cols())
    return event_poses(t).select(
        "event_id",
        *[g.clean(c).alias(n) for c, n in zip(centre, ("cx", "cy", "cz"))],
        *[g.clean(c).alias(n) for c, n in zip(ahead, ("fx", "fy", "fz"))],
    )


@query(
    "pose_to_plan",
    f"""WITH {EVENT_QUAT_SQL},
    c AS (SELECT event_id, -(r00*tx+r10*ty+r20*tz) AS cx, -(r01*tx+r11*ty+r21*tz) AS cy,
                 -(r02*tx+r12*ty+r22*tz) AS cz, r20 AS fx, r21 AS fy, r22 AS fz FROM r),
    p AS (SELECT event_id, event_id % 10 <> 3 AS known,
                 20.0*cx + 0.5*cy - 1.5*cz + 100 AS x0, 0.25*cx + 1.0*cy + 18.0*cz + 50 AS y0,
                 20.0*fx + 0.5*fy - 1.5*fz AS dx, 0.25*fx + 1.0*fy + 18.0*fz AS dy FROM c)
    SELECT event_id, CASE WHEN known THEN round(x0,5)+0.0 END AS x, CASE WHEN known THEN round(y0,5)+0.0 END AS y,
           CASE WHEN known THEN round(((degrees(atan2(dy,dx)) % 360) + 360) % 360,5)+0.0 END AS heading FROM p""",
)
def pose_to_plan(t):
    known = F.col("event_id") % 10 != 3
    # The floor's affine is missing for some frames: their pose on the plan is null.
    affine = [F.when(known, F.lit(v)) for v in (20.0, 0.5, -1.5, 100.0, 0.25, 1.0, 18.0, 50.0)]
    x, y, heading = g.pose_to_plan(rot_cols(), trans_cols(), affine)
    return event_poses(t).select(
        "event_id", g.clean(x, 5).alias("x"), g.clean(y, 5).alias("y"), g.clean(heading, 5).alias("heading")
    )


@query(
    "equirect_project",
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity - 25 AS x, l_discount*10 - l_tax*5 AS y,
                         l_extendedprice/1000 - 40 AS z FROM lineitem),
    n AS (SELECT *, sqrt(x*x+y*y+z*z) AS s FROM p),
    uv AS (SELECT *, CASE WHEN s >= 1e-10 THEN 1920*(atan2(x,z)/(2*pi())+0.5) END AS u,
                     CASE WHEN s >= 1e-10 THEN 960*(asin(y/s)/pi()+0.5) END AS v FROM n)
    SELECT l_orderkey, l_linenumber, l_partkey, round(u,4)+0.0 AS u, round(v,4)+0.0 AS v,
           round(x/s,5)+0.0 AS bx, round(y/s,5)+0.0 AS by, round(z/s,5)+0.0 AS bz FROM uv""",
)
def equirect_project(t):
    c = F.col
    p = t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        (c("l_quantity") - 25).alias("x"),
        (c("l_discount") * 10 - c("l_tax") * 5).alias("y"),
        (c("l_extendedprice") / 1000 - 40).alias("z"),
    )
    u, v = g.to_equirect([c("x"), c("y"), c("z")], 1920, 960)
    p = p.select("l_orderkey", "l_linenumber", "l_partkey", u.alias("u"), v.alias("v"))
    ray = g.equirect_bearing(c("u"), c("v"), 1920, 960)
    return p.select(
        "l_orderkey", "l_linenumber", "l_partkey", g.clean(c("u"), 4).alias("u"), g.clean(c("v"), 4).alias("v"),
        *[g.clean(r, 5).alias(n) for r, n in zip(ray, ("bx", "by", "bz"))],
    )


@query(
    "slice_cameras",
    """WITH s AS (SELECT p_partkey, CAST((p_partkey*20) % 360 AS DOUBLE) AS yaw, CAST((p_size % 7) * 10 - 30 AS DOUBLE) AS pitch,
                  60.0 + p_size AS fov, 1024 + p_size*8 AS pano FROM part),
    w AS (SELECT *, CAST(trunc(fov/360.0*pano) AS BIGINT) AS width FROM s),
    h AS (SELECT *, CAST(trunc(width*9/16) AS BIGINT) AS height FROM w)
    SELECT p_partkey, width, height, width//14*14 AS width14, height//14*14 AS height14,
      round(width/(2*tan(radians(fov)/2)),5)+0.0 AS focal,
      round(cos(radians(yaw))*cos(radians(pitch)),6)+0.0 AS r00, round(-sin(radians(yaw)),6)+0.0 AS r01,
      round(cos(radians(yaw))*sin(radians(pitch)),6)+0.0 AS r02, round(-sin(radians(pitch)),6)+0.0 AS r20,
      round(cos(radians(pitch)),6)+0.0 AS r22 FROM h""",
)
def slice_cameras(t):
    c = F.col
    s = t.part.select(
        "p_partkey",
        ((c("p_partkey") * 20) % 360).cast("double").alias("yaw"),
        ((c("p_size") % 7) * 10 - 30).cast("double").alias("pitch"),
        (c("p_size") + 60.0).alias("fov"),
        (c("p_size") * 8 + 1024).alias("pano"),
    )
    w, h = g.slice_size(c("pano"), c("fov"))
    s = s.select("*", w.alias("width")).withColumn("height", (c("width") * 9 / 16).cast("long"))
    rot = g.slice_rotation(c("yaw"), c("pitch"))
    return s.select(
        "p_partkey", "width", "height",
        (F.floor(c("width") / 14) * 14).alias("width14"), (F.floor(c("height") / 14) * 14).alias("height14"),
        g.clean(g.focal_length(c("width"), c("fov")), 5).alias("focal"),
        *[g.clean(rot[i]).alias(n) for i, n in ((0, "r00"), (1, "r01"), (2, "r02"), (6, "r20"), (8, "r22"))],
    )


@query(
    "level_yaw_pitch",
    f"""WITH {EVENT_QUAT_SQL},
    a AS (SELECT *, -r11 AS ax, r01 AS ay, radians((event_id*15) % 360) AS ty_ FROM r),
    s AS (SELECT *, sqrt(ax*ax+ay*ay) AS s, greatest(-1, least(1, -r21)) AS c FROM a),
    k AS (SELECT *, CASE WHEN s < 1e-6 THEN 0 ELSE ax/s END AS kx, CASE WHEN s < 1e-6 THEN 0 ELSE ay/s END AS ky,
                    CASE WHEN s < 1e-6 THEN 0 ELSE sin(acos(c)) END AS sn,
                    CASE WHEN s < 1e-6 THEN 1 ELSE cos(acos(c)) END AS cs FROM s),
    l AS (SELECT *, kx*kx*(1-cs)+cs AS l00, kx*ky*(1-cs) AS l01, ky*sn AS l02,
                    kx*ky*(1-cs) AS l10, ky*ky*(1-cs)+cs AS l11, -kx*sn AS l12,
                    -ky*sn AS l20, kx*sn AS l21, cs AS l22 FROM k),
    m AS (SELECT *, l00*r00+l01*r10+l02*r20 AS m00, l00*r01+l01*r11+l02*r21 AS m01, l00*r02+l01*r12+l02*r22 AS m02,
                    l10*r00+l11*r10+l12*r20 AS m10, l10*r01+l11*r11+l12*r21 AS m11, l10*r02+l11*r12+l12*r22 AS m12,
                    l20*r00+l21*r10+l22*r20 AS m20, l20*r01+l21*r11+l22*r21 AS m21, l20*r02+l21*r12+l22*r22 AS m22 FROM l),
    tt AS (SELECT *, cos(ty_)*m02+sin(ty_)*m22 AS t02, m12 AS t12, -sin(ty_)*m02+cos(ty_)*m22 AS t22 FROM m),
    d AS (SELECT event_id, r00*t02+r10*t12+r20*t22 AS d02, r01*t02+r11*t12+r21*t22 AS d12,
                 r02*t02+r12*t12+r22*t22 AS d22 FROM tt)
    SELECT event_id, round(degrees(asin(greatest(-1,least(1,d02)))),3)+0.0 AS yaw,
           CASE WHEN abs(d02) < 0.9999 THEN round(degrees(atan2(-d12,d22)),3)+0.0 END AS pitch FROM d""",
)
def level_yaw_pitch(t):
    yaw, pitch = g.level_yaw_pitch(rot_cols(), ((F.col("event_id") * 15) % 360).cast("double"))
    out = event_poses(t).select("event_id", yaw.alias("yaw"), pitch.alias("pitch"))
    # Looking straight sideways (gimbal lock) leaves pitch undefined.
    return out.select(
        "event_id", g.clean(F.col("yaw"), 3).alias("yaw"),
        F.when(F.abs(F.sin(F.radians("yaw"))) < 0.9999, g.clean(F.col("pitch"), 3)).alias("pitch"),
    )


@query(
    "turn_classes",
    """WITH t AS (SELECT event_id, ((value*7.3 + 180) % 360 + 360) % 360 - 180 AS turn FROM events)
    SELECT event_id, round(turn,4)+0.0 AS turn,
      CASE WHEN abs(turn)<=15 THEN 'ahead' WHEN abs(turn)<=45 THEN 'very_slight' WHEN abs(turn)<=75 THEN 'slight'
           WHEN abs(turn)<=105 THEN 'turn' WHEN abs(turn)<=135 THEN 'sharp' WHEN abs(turn)<=165 THEN 'very_sharp'
           ELSE 'u_turn' END AS qual,
      CASE WHEN turn < 0 THEN 'right' ELSE 'left' END AS side,
      CASE WHEN (CAST(round_even(-turn/30,0) AS BIGINT) % 12 + 12) % 12 = 0 THEN 12
           ELSE (CAST(round_even(-turn/30,0) AS BIGINT) % 12 + 12) % 12 END AS hour,
      least(180, CAST(round_even(abs(turn)/15,0) AS BIGINT)*15) AS deg15 FROM t""",
)
def turn_classes(t):
    turn = F.col("turn")
    return t.events.select("event_id", angles.normalize(F.col("value") * 7.3).alias("turn")).select(
        "event_id", g.clean(turn, 4).alias("turn"), angles.sector(turn).alias("qual"),
        angles.side(turn).alias("side"), angles.clock_hour(turn).alias("hour"), angles.quantize15(turn).alias("deg15"),
    )


@query(
    "unit_text",
    f"""WITH {UNITS_SQL},
    v AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'meter' ELSE 'feet' END AS unit,
                 ['en','zh','th','fr'][CAST(event_id % 4 AS INT) + 1] AS lang, value/10 AS metres FROM events),
    x AS (SELECT *, CASE WHEN unit='feet' THEN metres*3.28084 ELSE metres END AS val FROM v),
    n AS (SELECT *, CAST(round_even(val,0) AS BIGINT) AS n FROM x)
    SELECT event_id, round(val,9)+0.0 AS val, replace(coalesce(a.txt,b.txt),'{{v}}',CAST(n AS VARCHAR)) AS txt
    FROM n LEFT JOIN units a ON a.k = CASE WHEN n=1 THEN unit||'_1' ELSE unit END AND a.lang=n.lang
           JOIN units b ON b.k = CASE WHEN n=1 THEN unit||'_1' ELSE unit END AND b.lang='en'""",
)
def unit_text(t):
    c = F.col
    langs = F.array(*[F.lit(x) for x in ("en", "zh", "th", "fr")])
    v = t.events.select(
        "event_id",
        F.when(c("event_id") % 2 == 0, "meter").otherwise("feet").alias("unit"),
        langs[(c("event_id") % 4).cast("int")].alias("lang"),
        (c("value") / 10).alias("metres"),
    )
    v = v.select("*", text.distance_value(c("metres"), c("unit")).alias("val"))
    return v.select(
        "event_id", g.clean(c("val"), 9).alias("val"), text.unit_phrase(c("val"), c("unit"), c("lang")).alias("txt")
    )


@query(
    "hint_bearing",
    """SELECT doc_id, CASE WHEN contains(lower(text),'up') THEN 90.0::DOUBLE WHEN contains(lower(text),'right') THEN 0.0
        WHEN contains(lower(text),'down') THEN -90.0 WHEN contains(lower(text),'left') THEN 180.0
        ELSE CAST(doc_id % 360 AS DOUBLE) END AS bearing FROM documents""",
)
def hint_bearing(t):
    return t.documents.select(
        "doc_id", angles.hint_bearing(F.col("text"), (F.col("doc_id") % 360).cast("double")).alias("bearing")
    )


@query(
    "render_text",
    f"""WITH {TEMPLATES_SQL}, {QUALIFIERS_SQL}, {SIDES_SQL}, {ARRIVALS_SQL},
    ks AS (SELECT row_number() OVER (ORDER BY k) - 1 AS i, k FROM (SELECT DISTINCT k FROM templates)),
    e AS (SELECT event_id, ks.k, ['en','zh','th','fr'][CAST(event_id % 4 AS INT) + 1] AS lang,
            ['ahead','very_slight','slight','turn','sharp','very_sharp','u_turn'][CAST(event_id % 7 AS INT) + 1] AS qual,
            CASE WHEN event_id % 2 = 0 THEN 'left' ELSE 'right' END AS side,
            CAST(event_id % 12 + 1 AS VARCHAR) AS hour, CAST(event_id % 13 * 15 AS VARCHAR) AS deg,
            event_type AS label, 'R_'||user_id AS room, (user_id % 9)||'_floor' AS floor,
            'B'||(user_id % 5) AS building, 'P'||(user_id % 3) AS place,
            CAST(CAST(round_even(value,0) AS BIGINT) AS VARCHAR)||' m' AS dist
          FROM events JOIN ks ON ks.i = (event_id // 7) % 17),
    x AS (SELECT e.*, CASE WHEN e.k IN ('turn','turn_deg') AND qual='u_turn' THEN 'u_turn' ELSE e.k END AS uk,
            CASE WHEN lang IN ('en','zh','th') THEN lang ELSE 'en' END AS kl FROM e),
    y AS (SELECT x.*, coalesce(q.txt, x.qual) AS qw, coalesce(s.txt, x.side) AS sw, coalesce(a.txt, b.txt) AS aw,
                 coalesce(t1.txt, t2.txt) AS tpl
          FROM x LEFT JOIN quals q ON q.lang=kl AND q.k=x.qual LEFT JOIN sides s ON s.lang=kl AND s.k=x.side
          LEFT JOIN arrivals a ON a.lang=kl AND a.k=CASE WHEN qual='u_turn' THEN 'u_turn' ELSE qual||'_'||side END
          LEFT JOIN arrivals b ON b.lang=kl AND b.k='ahead'
          LEFT JOIN templates t1 ON t1.k=uk AND t1.lang=x.lang JOIN templates t2 ON t2.k=uk AND t2.lang='en'),
    z AS (SELECT event_id, k, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(
        tpl,'{{room}}',room),'{{floor}}',floor),'{{building}}',building),'{{place}}',place),'{{dist}}',dist),'{{door_dist}}',dist),
        '{{hour}}',hour),'{{deg}}',deg),'{{label}}',label),'{{qual}}',qw),
        '{{direction}}',CASE WHEN k IN ('turn','turn_deg') THEN sw ELSE side END),'{{dir_word}}',aw) AS raw FROM y)
    SELECT event_id, k AS tag, {speak_sql("raw")} AS sentence FROM z""",
)
def render_text(t):
    c = F.col
    keys = F.array(*[F.lit(k) for k in sorted(text.TEMPLATES)])
    langs = F.array(*[F.lit(x) for x in ("en", "zh", "th", "fr")])
    quals = F.array(*[F.lit(x) for x in ("ahead", "very_slight", "slight", "turn", "sharp", "very_sharp", "u_turn")])
    e = c("event_id")
    rows = t.events.select(
        "event_id",
        keys[(F.floor(e / 7) % 17).cast("int")].alias("tag"),
        langs[(e % 4).cast("int")].alias("lang"),
        quals[(e % 7).cast("int")].alias("qual"),
        F.when(e % 2 == 0, "left").otherwise("right").alias("direction"),
        (e % 12 + 1).alias("hour"),
        (e % 13 * 15).alias("deg"),
        c("event_type").alias("label"),
        F.concat(F.lit("R_"), c("user_id")).alias("room"),
        F.concat(c("user_id") % 9, F.lit("_floor")).alias("floor"),
        F.concat(F.lit("B"), c("user_id") % 5).alias("building"),
        F.concat(F.lit("P"), c("user_id") % 3).alias("place"),
        F.concat(F.bround("value", 0).cast("long"), F.lit(" m")).alias("dist"),
    )
    tokens = {n: c(n) for n in ("room", "floor", "building", "place", "dist", "hour", "deg", "label", "qual", "direction")}
    tokens["door_dist"] = c("dist")
    return rows.select("event_id", "tag", text.sentence(c("tag"), c("lang"), tokens).alias("sentence"))


@query("tts_sanitize", f"SELECT doc_id, {speak_sql('text')} AS spoken FROM documents")
def tts_sanitize(t):
    return t.documents.select("doc_id", text.speakable(F.col("text")).alias("spoken"))


@query(
    "pair_id",
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
        least(l_partkey,l_suppkey)*2147483647 + greatest(l_partkey,l_suppkey) AS pid FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, pid, (pid - pid % 2147483647)//2147483647 AS id1, pid % 2147483647 AS id2 FROM p""",
)
def pair_id(t):
    p = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        names.pair_id(F.col("l_partkey"), F.col("l_suppkey")).alias("pid"),
    )
    a, b = names.pair_members(F.col("pid"))
    return p.select("*", a.alias("id1"), b.alias("id2"))


@query(
    "floor_direction",
    """WITH f AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'lobby'||event_type ELSE (user_id % 12)||'_floor' END AS a,
                   CASE WHEN event_id % 7 = 0 THEN 'mezzanine' ELSE 'F'||(event_id % 11) END AS b FROM events),
    n AS (SELECT *, TRY_CAST(regexp_replace(a,'\\D','','g') AS BIGINT) AS na, TRY_CAST(regexp_replace(b,'\\D','','g') AS BIGINT) AS nb FROM f)
    SELECT event_id, a AS floor_from, b AS floor_to, na AS num_from, nb AS num_to,
      CASE WHEN na IS NOT NULL AND nb IS NOT NULL THEN CASE WHEN nb > na THEN 'up' ELSE 'down' END
           WHEN b > a THEN 'up' ELSE 'down' END AS direction FROM n""",
)
def floor_direction(t):
    c = F.col
    f = t.events.select(
        "event_id",
        F.when(c("event_id") % 5 == 0, F.concat(F.lit("lobby"), c("event_type")))
        .otherwise(F.concat(c("user_id") % 12, F.lit("_floor"))).alias("floor_from"),
        F.when(c("event_id") % 7 == 0, F.lit("mezzanine"))
        .otherwise(F.concat(F.lit("F"), c("event_id") % 11)).alias("floor_to"),
    )
    return f.select(
        "*", names.floor_number(c("floor_from")).alias("num_from"), names.floor_number(c("floor_to")).alias("num_to"),
        names.floor_direction(c("floor_from"), c("floor_to")).alias("direction"),
    )
