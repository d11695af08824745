"""The ordered folds of the batch engine as stateful stream operators."""
