"""Kill the process in the middle of a versioned overwrite; used by test_quality."""

import os
import sys
import threading
import time
import glob

from pyspark.sql import SparkSession, functions as F

from millrace import write_dataset


def main(folder):
    spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    target = {"path": folder, "format": "parquet", "versioned": True}
    write_dataset(spark.range(100), target)
    slow = spark.range(0, 1000, 1, 50).filter(F.expr("java_method('java.lang.Thread', 'sleep', 20L) IS NULL"))

    def kill():
        # The second version's folder is there, its rows are not.
        while len(glob.glob(f"{folder}/_versions/*")) < 2:
            time.sleep(0.05)
        time.sleep(0.5)
        os._exit(9)

    threading.Thread(target=kill, daemon=True).start()
    write_dataset(slow, target)


if __name__ == "__main__":
    main(sys.argv[1])
