"""Optional adapters: sample frames as torch datasets, and as TorchIO subjects. Both libraries are imported on use."""

from __future__ import annotations


def as_torch(frame):
    """A map-style torch dataset over a frame; arrays become tensors."""
    try:
        import torch
    except ImportError as e:
        raise ImportError("as_torch needs torch") from e
    import numpy as np

    class Dataset(torch.utils.data.Dataset):
        def __len__(self):
            return len(frame)

        def __getitem__(self, i):
            return {k: torch.from_numpy(np.ascontiguousarray(v)) if isinstance(v, np.ndarray) else v for k, v in frame[i].items()}

    return Dataset()


def as_torchio(volumes: dict, labels: dict | None = None):
    """TorchIO subjects of aligned collections: {name: VolumeSet}; names in ``labels`` are label maps."""
    try:
        import torch
        import torchio
    except ImportError as e:
        raise ImportError("as_torchio needs torch and torchio") from e
    from tomolake.operators.samples import check_alignment

    check_alignment(list(volumes.values()))
    ids = {n: v.index.to_list() for n, v in volumes.items()}
    out = []
    for k in range(len(next(iter(ids.values())))):
        images = {}
        for n, v in volumes.items():
            kind = torchio.LabelMap if labels and n in labels else torchio.ScalarImage
            images[n] = kind(tensor=torch.from_numpy(v.volume(ids[n][k]).to_numpy())[None])
        out.append(torchio.Subject(**images))
    return torchio.SubjectsDataset(out)
