"""Kitty graphics escape sequences as arrays of chunks, in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, STOP = "\x1b_G", "\x1b\\"
FIRST, FIRST_FRAME, NEXT = 3800, 3700, 4088


def base64_text(data: Column) -> Column:
    """RFC 4648 without line breaks, which Spark's own function would insert."""
    return F.replace(F.base64(data), F.lit("\r\n"), F.lit(""))


def chunks(data: Column, first: int = FIRST, rest: int = NEXT) -> Column:
    """Base64 of ``data`` cut into a first part and further ones."""
    text = base64_text(data)
    more = F.ceil((F.length(text) - first) / rest).cast("int")
    tail = F.when(more > 0, F.transform(F.sequence(F.lit(0), more - 1), lambda k: F.substr(text, k * rest + first + 1, F.lit(rest))))
    return F.concat(F.array(F.substring(text, 1, first)), F.coalesce(tail, F.array().cast("array<string>")))


def sequences(parts: Column, head: Column, prefix: str = "") -> Column:
    """Escape sequences of the parts: the first carries ``head``, all say whether more follow."""
    return F.transform(
        parts,
        lambda p, k: F.concat(
            F.lit(START), F.when(k == 0, head).otherwise(F.lit(prefix)), F.lit("m="), F.when(k + 1 < F.size(parts), "1").otherwise("0"), F.lit(";"), p, F.lit(STOP)
        ),
    )


def still(images: DataFrame, *, columns: int = 0, rows: int = 0, placement: Column | None = None, image_id: Column | None = None) -> DataFrame:
    """``images`` with ``kitty``: RGBA sent raw, shown in so many cells."""
    place = (f"c={columns}," if columns else "") + (f"r={rows}," if rows else "")
    number = image_id if image_id is not None else F.lit(1)
    head = F.concat(
        F.lit("f=32,s="), "width", F.lit(",v="), "height", F.lit("," + place + "i="), number.cast("string"),
        F.lit(",p="), (placement if placement is not None else F.lit(1)).cast("string"), F.lit(",a=T,q=1,"),
    )
    text = F.concat(F.array_join(sequences(F.col("__parts"), head), ""), F.lit("\n"))
    return images.withColumn("__parts", chunks(F.col("rgba"))).withColumn("kitty", text).drop("__parts")


def animation(frames: DataFrame, *, image_id: int = 1, placement: int = 1) -> DataFrame:
    """(path, kitty) of frames in order: the first as a still, the others as frames with their gaps."""
    number = F.lit(image_id)
    first = still(frames.where("frame_no = 0"), image_id=number, placement=F.lit(placement)).select("path", "frame_no", "kitty")
    head = F.concat(
        F.lit("a=f,i="), number.cast("string"), F.lit(",s="), "width", F.lit(",v="), "height", F.lit(",z="), F.col("delay_ms").cast("string"), F.lit(",q=1,")
    )
    later = frames.where("frame_no > 0").withColumn("__parts", chunks(F.col("rgba"), FIRST_FRAME))
    later = later.select("path", "frame_no", F.array_join(sequences(F.col("__parts"), head, "a=f,"), "").alias("kitty"))
    gap = frames.groupBy("path").agg(F.max_by("delay_ms", -F.col("frame_no")).alias("gap"), F.count(F.lit(1)).alias("n"))
    joined = first.unionByName(later).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("frame_no", "kitty"))).alias("parts"))
    run = F.concat(
        F.lit(f"{START}a=a,i={image_id},r=1,z="), F.col("gap").cast("string"), F.lit(f",q=1{STOP}{START}a=a,i={image_id},s=3,v=1,q=1{STOP}\n")
    )
    return joined.join(gap, "path").select(
        "path", F.concat(F.array_join(F.transform("parts", lambda p: p["kitty"]), ""), F.when(F.col("n") > 1, run).otherwise(F.lit(""))).alias("kitty")
    )


def delete_all() -> Column:
    return F.lit(f"{START}a=d{STOP}")


def delete_image(image_id: Column) -> Column:
    return F.concat(F.lit(f"{START}a=d,d=i,i="), image_id.cast("string"), F.lit(STOP))


def delete_placement(image_id: Column, placement: Column) -> Column:
    return F.concat(F.lit(f"{START}a=d,d=p,i="), image_id.cast("string"), F.lit(",p="), placement.cast("string"), F.lit(STOP))
