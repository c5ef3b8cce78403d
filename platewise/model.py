"""Fixed dimension values: food labels, their families, and mask colours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Label id, name, family.
LABELS = [
    (0, "Background", "none"),
    (1, "pasta with pesto", "first"),
    (2, "pasta with tomato sauce", "first"),
    (3, "pasta with meat sauce", "first"),
    (4, "pasta with clams and mussels", "first"),
    (5, "pilaw rice with peppers and peas", "first"),
    (6, "grilled pork cutlet", "second"),
    (7, "fish cutlet", "second"),
    (8, "rabbit", "second"),
    (9, "seafood salad", "second"),
    (10, "beans", "side"),
    (11, "basil potatoes", "side"),
    (12, "salad", "salad"),
    (13, "bread", "bread"),
]
# Mask colour (blue, green, red) by label id.
COLOURS = {
    0: (0, 0, 0),
    1: (0, 255, 124),
    2: (0, 0, 255),
    3: (255, 0, 0),
    4: (0, 255, 255),
    5: (255, 255, 0),
    6: (255, 0, 255),
    7: (0, 165, 255),
    8: (128, 0, 128),
    9: (203, 192, 255),
    10: (51, 102, 153),
    11: (128, 128, 128),
    12: (255, 255, 255),
    13: (128, 128, 0),
}
#: The circle constant of area thresholds, and the label range of food.
CIRCLE, FOOD_LOW, FOOD_HIGH = 3.141, 1, 13
#: The recall points of interpolated average precision.
RECALL_POINTS = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]


def labels_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LABELS, "id int, name string, family string")


def colours_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in COLOURS.items()], "label int, blue int, green int, red int")
