"""Materialisation of a frame that several passes read."""

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data that the driver and all executors see.

    It is the one the cluster names in `spark.checkpoint.dir`; a session without the setting uses a
    folder in its warehouse, which is shared as well.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Reliable checkpoint of a frame in the shared folder, for passes that read it more than once.

    Select the columns that are read before: a checkpoint has no column pruning.
    """
    context = frame.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(frame.sparkSession))
    return frame.checkpoint(eager=True)
