"""Steps of a pipeline as transformations of DataFrames; none of them runs a job."""
