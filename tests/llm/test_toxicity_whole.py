import numpy as np

from thicket.llm import toxicity
from thicket.llm.toxicity import GRID, Local, Model, Spread


def test_samples_have_their_former_size():
    assert (toxicity.MAX_POSITIVE, toxicity.MAX_NEGATIVE, toxicity.MAX_UNLABELLED) == (3_000, 8_000, 16_000)


def test_figures_are_of_all_documents(spark):
    texts = [f"the word{i % 7} cache was rebuilt. item{i} went to the queue again" for i in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    spread = Spread(df, 40)
    split = [toxicity.sentences(t) for t in texts]
    whole = Local(split, [])
    assert len(list(spread.training())) == 40
    assert spread.frequent(20) == whole.frequent(20) and spread.frequent(20)["cache"] == 200
    model = Model(np.random.default_rng(1).normal(size=toxicity.DIM).astype(np.float32), 0.0, 0.02)
    assert spread.share(model, 0.5) == whole.share(model, 0.5)
    ((u, n),) = spread.tops([model])
    assert n.sum() == 160 and (np.diff(u) < 0).all()
    every = {round(max(model.sentence(s) for s in b) / GRID) for b in split}
    assert {round(x / GRID) for x in u} <= every


def test_single_documents_do_not_move_the_cut():
    # 70 documents are far above the rest; four of the held ones lie low among the 18 that come next, then there is nothing but ordinary ones
    unseen = np.concatenate([np.linspace(3, 15, 70), np.linspace(-1.5, -0.5, 18), np.linspace(-9, -5, 2400)])
    unseen = np.sort(unseen)[::-1]
    held = np.concatenate([np.linspace(2.9, 14, 50), [-1.4, -1.42, -1.45, -1.48], np.linspace(-12, -8, 18)])
    number = np.arange(1, len(unseen) + 1)
    assert 65 <= number[toxicity._best_cut(toxicity._recall(held, unseen), number)] <= 80


def test_sentences_of_documents_labelled_clean_by_mistake_are_no_evidence():
    class Finds:
        def sentence(self, words):
            return 5.0 if "moron" in words else -5.0

    known = [[["you", "are", "a", "moron"], ["the", "cache", "is", "full"]], [["nothing", "here"]]]
    assert toxicity.confirmed(known, [Finds(), Finds()]) == [[["the", "cache", "is", "full"]], [["nothing", "here"]]]
    assert toxicity.confirmed(known, []) == known
