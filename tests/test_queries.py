import pytest
from oracle import agree

from quarryline.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_agrees_with_sql(spark, data, name):
    agree(spark, catalogue.queries()[name], catalogue.oracle_sql()[name], data)


#: Of queries without SQL, the least rows and a condition that each of them meets; their operators have tests of their own.
BOUNDS = {
    "augmented_rows": (200, "size is not null"),
    "cross_validated_grid": (3, "rmse > 0 and rmse < 50"),
    "group_folds": (10, "fold between 0 and 4 and n > 0"),
    "login_throttle": (1000, "failures between 0 and 5"),
    "predict_regression": (1000, "low <= prediction and prediction <= high"),
    "search_fuzzy": (1, "score >= 82"),
    "search_hybrid": (0, "score >= 40"),
    "search_semantic": (1, "score >= 2.5"),
    "suggested_synonyms": (1, "size >= 2 and similarity >= 85 and contains(members, standard)"),
    "similar_names": (1, "u < v and similarity >= 85"),
    "text_similarity": (1, "ratio between 0 and 1 and partial between 0 and 100"),
    "train_ridge": (1, "r2 > 0.9"),
    "train_random_forest": (1, "r2 > 0.9"),
    "train_gradient_boosting": (1, "r2 > 0.9"),
    "train_logistic": (1, "accuracy > 0.9"),
    "train_random_forest_classifier": (1, "accuracy > 0.9"),
    "train_gradient_boosting_classifier": (1, "accuracy > 0.9"),
    "train_linear_svc": (1, "accuracy > 0.9"),
    "train_neural_classifier": (1, "accuracy > 0.95"),
}


#: Held to their bounds by test_lifecycle.
ELSEWHERE = {"model_selection", "optimise_model", "permutation_importance", "predict_classes"}


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql()) - ELSEWHERE))
def test_bounds(spark, data, name):
    least, condition = BOUNDS[name]
    got = catalogue.queries()[name](spark, data)
    assert got.count() >= least and got.filter(f"not ({condition})").count() == 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
