"""voxelyard: point-cloud analytics and corpus preparation on Spark DataFrames."""
