"""seenscope: was this benchmark item in the training data?

Item tables, prompts, splits, an n-gram language model, lowest-k% scores, update
trajectories, thresholds, classifiers and report tables, all as functions from
DataFrame to DataFrame.
"""
