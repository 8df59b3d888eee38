"""Training visits every position of the training texts once, at any size."""

from wattline.llm import language_model


def test_every_position_is_visited_once(spark):
    rows = [" ".join(f"w{(i * k) % 37}" for k in range(50)) for i in range(200)] + [None, ""]
    df = spark.createDataFrame([(t if t is None else t.encode(),) for t in rows], "t binary")
    hashes = [language_model.END, *(language_model.word_hash(f"w{k}".encode()) for k in range(37))]
    # A table said to be large must not be visited in part: the total is that of a terabyte.
    vocab = language_model.Vocabulary(hashes, [202] + [270] * 37, 10**11, 38, language_model.Config())
    for rounds in (1, 2):
        _, visited = language_model.train(df.repartition(3), vocab, language_model.Config(rounds=rounds))
        assert visited == 200 * 51 + 2
