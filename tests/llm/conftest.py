import pytest


@pytest.fixture(scope="session")
def ranks():
    from chainsieve.llm.encode import TOKENIZERS, read_ranks

    return read_ranks(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    from chainsieve.session import checkpoint_dir

    checkpoint_dir(spark, str(tmp_path_factory.mktemp("shared")))
