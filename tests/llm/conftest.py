import pytest

MODEL = "piece_bpe_32k.model"


@pytest.fixture(scope="session")
def model():
    import public_tokenizers

    return public_tokenizers.path(MODEL)
